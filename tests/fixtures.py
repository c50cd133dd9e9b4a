"""A small service as a graph: controllers, services, a database, a test, settings."""

import json

REPO = {"api": "shop-api", "core": "shop-core", "web": "shop-web"}
NODES = [
    # id, label, type, file, repo, community
    ("fn:open_db", "open_db", "function", "shop-core/src/db/connection.py", "core", "0"),
    ("fn:load_user", "load_user", "function", "shop-api/src/services/users.py", "api", "1"),
    ("fn:change_user", "change_user", "function", "shop-api/src/services/users.py", "api", "1"),
    ("cls:Users", "Users", "class", "shop-api/src/controllers/users.py", "api", "2"),
    ("fn:Users.get", "Users.get", "function", "shop-api/src/controllers/users.py", "api", "2"),
    ("fn:place_order", "place_order", "function", "shop-api/src/services/orders.py", "api", None),
    ("fn:db_health", "db_health", "function", "shop-web/src/health.py", "web", None),
    ("fn:valid_user", "valid_user", "function", "shop-api/src/validators/user.py", "api", None),
    ("fn:test_load_user", "test_load_user", "function", "shop-api/tests/test_users.py", "api", None),
    ("mod:settings", "settings", "module", "shop-core/src/settings.py", "core", None),
    ("fn:db_url", "db_url", "function", "shop-core/src/settings.py", "core", "0"),
    ("cls:Auth", "Auth", "class", "shop-api/src/auth/auth.py", "api", "3"),
    ("fn:sign_in", "sign_in", "function", "shop-api/src/auth/service.py", "api", "3"),
]
EDGES = [
    ("fn:load_user", "fn:open_db", "calls"),
    ("fn:load_user", "fn:valid_user", "calls"),
    ("fn:change_user", "fn:load_user", "calls"),
    ("fn:Users.get", "fn:load_user", "calls"),
    ("fn:place_order", "fn:open_db", "calls"),
    ("fn:place_order", "fn:load_user", "calls"),
    ("fn:db_health", "fn:open_db", "calls"),
    ("fn:open_db", "fn:db_url", "calls"),
    ("fn:test_load_user", "fn:load_user", "calls"),
    ("cls:Users", "fn:Users.get", "contains"),
    ("fn:load_user", "mod:settings", "imports"),
    ("cls:Auth", "fn:sign_in", "contains"),
]


def as_json(path, dialect=0):
    """The graph in a JSON file, in one of the dialects that readers meet."""
    a, b, t, e = [("source", "target", "type", "edges"), ("_src", "_tgt", "relation", "links"), ("from", "to", "type", "links")][dialect]
    nodes = [{"id": i, "label": label, "type": kind, "source_file": f, "repo": REPO[r], "community": c, "source_location": f"L{3 + k}-L{9 + k}", "properties": {"signature": f"{label}()"}} for k, (i, label, kind, f, r, c) in enumerate(NODES)]
    with open(path, "w") as f:
        json.dump({"nodes": nodes, e: [{a: x, b: y, t: z, "confidence_score": 0.5} for x, y, z in EDGES], "metadata": {"repos": list(REPO.values())}}, f)
    return str(path)
