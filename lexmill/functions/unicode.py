"""Functions that need Unicode normal forms or YAML; Arrow-batched, never per row calls from the JVM."""

from __future__ import annotations

import json
import posixpath
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Path names that slugs must not take.
RESERVED = ("index", "readme", "home")


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(StringType())
def ascii_letters(x: pd.Series) -> pd.Series:
    """Compatibility decomposition with all that is not ASCII left out."""
    return x.map(lambda v: unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode(), na_action="ignore")


def readable_slug(x):
    """ASCII slug of at most 80 characters; null where nothing is left."""
    y = F.regexp_replace(F.regexp_replace(F.lower(ascii_letters(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    y = F.regexp_replace(F.substring(y, 1, 80), "-+$", "")
    return F.when(y != "", y)


def strict_slug(x, reserved: tuple[str, ...] = RESERVED):
    """Slug of the composed form; letters of any script stay; reserved names get 'x-' before them."""
    y = F.regexp_replace(F.regexp_replace(F.lower(nfkc(x)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(y.isin(*reserved), F.concat(F.lit("x-"), y)).otherwise(y)


@F.pandas_udf(StringType())
def evidence_slug(x: pd.Series) -> pd.Series:
    """ASCII letters and digits as they are, other letters as uXXXX, everything else as a hyphen."""

    def one(v: str) -> str:
        v = unicodedata.normalize("NFKC", v).lower()
        out = "".join(c if c.isascii() and c.isalnum() else f"-u{ord(c):04x}-" if c.isalnum() else "-" for c in v)
        return re.sub("-+", "-", out).strip("-") or "item"

    return x.map(one, na_action="ignore")


def semantic_form(x):
    """Composed, lower case, without file endings, numbers in front and joining words."""
    y = F.lower(F.trim(nfkc(x)))
    for pattern in (r"\.(md|txt|json)$", r"^[0-9]+[.)、_ -]*", r"\b(and|the|of)\b", r"[\s_-]+"):
        y = F.regexp_replace(y, pattern, " ")
    return F.trim(y)


@F.pandas_udf(StringType())
def frontmatter_json(x: pd.Series) -> pd.Series:
    """A page's YAML frontmatter as JSON with sorted keys; null without one or if it is no mapping."""
    try:
        import yaml

        load = yaml.safe_load
    except ImportError:
        load = _plain_yaml

    def one(v: str):
        m = re.match(r"\A---\r?\n(.*?)\r?\n---\r?\n", v, re.S)
        if not m:
            return None
        try:
            value = load(m[1])
        except Exception:  # any malformed block counts as none
            return None
        return json.dumps(value, sort_keys=True, ensure_ascii=False, default=str) if isinstance(value, dict) else None

    return x.map(one, na_action="ignore")


def _plain_yaml(block: str) -> dict:
    """'key: value' lines, where no YAML library is there."""
    pairs = [line.split(":", 1) for line in block.splitlines() if line.strip()]
    if any(len(p) != 2 for p in pairs):
        raise ValueError("not a flat mapping")
    out = {}
    for k, v in pairs:
        v = v.strip().strip("'\"")
        out[k.strip()] = int(v) if re.fullmatch(r"-?[0-9]+", v) else {"true": True, "false": False, "": None}.get(v, v)
    return out


@F.pandas_udf(StringType())
def relative_link(source: pd.Series, target: pd.Series) -> pd.Series:
    """The path from one page to another."""
    return pd.Series([None if a is None or b is None else posixpath.relpath(b, posixpath.dirname(a) or ".") for a, b in zip(source, target, strict=True)])


def frontmatter_pairs(x):
    """Simple 'key: value' frontmatter as a map."""
    block = F.regexp_extract(x, r"(?s)\A---\n(.*?)\n---\n", 1)
    rows = F.filter(F.split(block, "\n"), lambda v: v.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    return F.map_from_entries(F.transform(rows, lambda v: F.struct(F.trim(F.regexp_extract(v, "^([^:]+):", 1)).alias("k"), F.trim(F.regexp_replace(v, "^[^:]+:", "")).alias("v"))))
