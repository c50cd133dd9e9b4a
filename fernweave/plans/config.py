"""Settings with defaults; YAML where a parser is installed, else JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass
class Scan:
    """Which files: endings by type, globs, folders left out, the largest size."""

    types: dict = field(default_factory=lambda: {"code": {"endings": [".py"]}, "docs": {"endings": [".md", ".txt", ".rst"]}})
    include: list = field(default_factory=list)
    exclude: list = field(default_factory=list)
    exclude_common: bool = True
    max_kb: int = 1024


@dataclass
class Enrich:
    """How much is described and what counts as a candidate."""

    mode: str = "algorithmic"
    threshold: float = 0.8
    boundary_threshold: float = 0.3
    batch_tokens: int = 4096
    chunk: int = 30


@dataclass
class Embed:
    provider: str = "tfidf"
    dimensions: int = 384
    batch_size: int = 128


@dataclass
class Config:
    root: str = "."
    repos: dict = field(default_factory=dict)
    output: str = "graph"
    scan: Scan = field(default_factory=Scan)
    enrich: Enrich = field(default_factory=Enrich)
    embed: Embed = field(default_factory=Embed)
    services: dict = field(default_factory=dict)
    plugins: dict = field(default_factory=dict)


#: What a kind of service must say, and what it can be used for.
SERVICES = {"http": ("url", "model"), "local": ("model",), "vectors": ("model",)}
USES = {"embed.provider": ("http", "vectors"), "enrich.mode": ("http", "local")}
#: Settings of a plugin that the engine itself reads; an extractor does not get them.
OWN_KEYS = ("enabled", "endings", "include", "exclude")
MODES, PROVIDERS = ("algorithmic", "callable", "off"), ("tfidf", "callable", "off")


def _fill(kind: type, given: dict, where: str = "") -> object:
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(where + u for u in unknown)}")
    out = kind()
    for name, value in given.items():
        now = getattr(out, name)
        if is_dataclass(now):
            if not isinstance(value, dict):
                raise ValueError(f"{where}{name} has settings of its own")
            value = _fill(type(now), value, f"{where}{name}.")
        elif type(now) is float and type(value) is int:
            value = float(value)
        elif type(value) is not type(now):
            raise ValueError(f"{where}{name} is a {type(now).__name__}")
        setattr(out, name, value)
    return out


def load_config(path: str) -> Config:
    """The settings in a file; those under an outer `build` count as well. ValueError names what is wrong."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        given = json.loads(text)
    else:
        import yaml

        given = yaml.safe_load(text)
    given = given or {}
    if isinstance(given.get("build"), dict):
        given = {**given.pop("build"), **given}
    config = _fill(Config, given)
    for name, service in config.services.items():
        kind = service.get("kind") if isinstance(service, dict) else None
        if kind not in SERVICES:
            raise ValueError(f"services.{name} has a kind, one of {', '.join(SERVICES)}")
        if lacking := [k for k in SERVICES[kind] if not service.get(k)]:
            raise ValueError(f"services.{name} ({kind}) lacks {', '.join(lacking)}")
    for where, own, given_ in (("enrich.mode", MODES, config.enrich.mode), ("embed.provider", PROVIDERS, config.embed.provider)):
        if given_ in own:
            continue
        if given_ not in config.services:
            raise ValueError(f"{where} is one of {', '.join(own)}, or one of the services")
        if (kind := config.services[given_]["kind"]) not in USES[where]:
            raise ValueError(f"{where} can't use {given_}, which is of kind {kind}")
    if not 0 <= config.enrich.threshold <= 1 or not 0 <= config.enrich.boundary_threshold <= 1:
        raise ValueError("thresholds lie between 0 and 1")
    return config


def plugin_settings(defaults: dict | None, given: dict | None) -> dict:
    """What an extractor is told: its defaults with what the user gave in their place, without the keys that are the engine's own."""
    return {k: v for k, v in {**(defaults or {}), **(given or {})}.items() if k not in OWN_KEYS}
