"""Text functions: query cleaning, LIKE as in the embedded engines, tokens, term hashes, paths."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what makes a path a test's, right after one of its slashes.
TEST_FILE = r"/(test_|tests/|_test\.|\.test\.|spec/|\.spec\.)"


def sanitise(query: str) -> str:
    """A search query without operators' characters."""
    return re.sub(r"[(){}\[\]\"^~*:]", "", query).strip()


def terms(query: str) -> list[str]:
    return sanitise(query).lower().split()


def ascii_lower(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def contains_like(column: Column, term: str) -> Column:
    """column LIKE '%term%', with case folded for ASCII only; _ and % in the term are wildcards, a backslash is itself. Null does not match."""
    pattern = "%" + term.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).replace("\\", "\\\\") + "%"
    return F.coalesce(ascii_lower(column).like(pattern), F.lit(False))


def is_test_file(path: Column) -> Column:
    """Null paths are none, and neither are paths whose first segment says so: no slash stands before it."""
    return F.coalesce(path.rlike(TEST_FILE), F.lit(False))


def tokens(column: Column) -> Column:
    """The tokens of a text: lower case, _ and what is neither a-z nor 0-9 part them, and one character is none."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(column), "_", " "), r"[^a-z0-9\s]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: F.length(t) >= 2)


def term_hash(term: Column) -> Column:
    """A term's 32-bit hash: FNV-1a in which each product is taken in double precision, so that low bits are lost as they are with such numbers."""
    codes = F.transform(F.filter(F.split(term, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))

    def step(h: Column, c: Column) -> Column:
        signed = F.shiftright(F.shiftleft(h.bitwiseXOR(c), 32), 32)
        return (signed.cast("double") * F.lit(16777619.0)).cast("long").bitwiseAND(F.lit(4294967295))

    return F.aggregate(codes, F.lit(2166136261).cast("long"), step)


def bucket(term: Column, dimensions: int = 384) -> Column:
    return term_hash(term) % dimensions


def sign(term: Column) -> Column:
    """1 or -1 by the parity of the hash of the term with a suffix."""
    return F.when(term_hash(F.concat(term, F.lit("_sign"))) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def token_count(text: Column) -> Column:
    """An estimate of the tokens in a text: a quarter of its length, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(4.0)).cast("long")


def posix(path: Column) -> Column:
    """A path with slashes in the place of backslashes."""
    return F.translate(path, "\\", "/")


def relative_to(path: Column, root: str) -> Column:
    """A path below root as seen from it, "" for root itself; null for one that lies elsewhere."""
    full, top = posix(path), root.replace("\\", "/").rstrip("/")
    return F.when(full == top, F.lit("")).when(full.startswith(top + "/"), F.substring(full, len(top) + 2, 1 << 30))


def grouped_number(n: Column) -> Column:
    """A whole number with a comma between thousands."""
    return F.format_number(n, 0)


def strip_fences(answer: Column) -> Column:
    """A JSON answer without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def parse_answer(answer: Column, schema: str) -> Column:
    """A JSON answer, fenced or not, as a value of a schema; null where it is no such JSON."""
    return F.from_json(strip_fences(answer), schema, {"mode": "PERMISSIVE"})


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The path up to its last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The lower-case extension with its dot; empty for names without one and for dotfiles."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def module_name(path: Column) -> Column:
    """a/b.md as a.b"""
    return F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), "/", ".")


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def glob_regex(pattern: str) -> str:
    """A glob as an anchored Java and Python regex: ** over directories, * and ? within one, {a,b}, [abc] and [!abc]; dotfiles match."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def matches_any(path: Column, patterns: list[str], prefix: str | None = None) -> Column:
    """Does a path match one of the globs: as it is, without the repository's prefix, or with it. No patterns match nothing."""
    if not patterns:
        return F.lit(False)
    forms = [path] + ([F.regexp_replace(path, f"^{re.escape(prefix)}/", ""), F.concat(F.lit(prefix + "/"), path)] if prefix else [])
    hit = F.lit(False)
    for p in patterns:
        for f in forms:
            hit = hit | f.rlike(glob_regex(p))
    return hit
