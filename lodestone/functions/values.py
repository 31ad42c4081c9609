"""Front matter values in Python: YAML in, canonical JSON and lists out."""

from __future__ import annotations

import json
import re
import unicodedata
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = re.compile(r"[,\s]+")


def whole(value: Any) -> Any:
    """Integral floats as integers, the way JSON writes them."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return int(value)
    if isinstance(value, dict):
        return {str(k): whole(v) for k, v in value.items()}
    return [whole(v) for v in value] if isinstance(value, list) else value


def compact(value: Any) -> str:
    return json.dumps(whole(value), separators=(",", ":"), ensure_ascii=False)


#: The order of ASCII marks in the root collation; digits and letters follow.
MARKS = "\t\n\x0b\x0c\r _-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$"


def collation(text: str) -> tuple:
    """A key that sorts as people do: letters before their accents, both before case, small letters first."""
    marks = unicodedata.normalize("NFD", text)
    plain = [c for c in marks if not unicodedata.combining(c)]
    place = lambda c: (0, MARKS.index(c)) if c in MARKS else (1 if c.isdigit() else 2, ord(c))
    return [place(x) for c in plain for x in c.casefold()], [c for c in marks if unicodedata.combining(c)], [c.isupper() for c in plain], text


def _ordered(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _ordered(value[k]) for k in sorted(value, key=collation)}
    return [_ordered(v) for v in value] if isinstance(value, list) else value


def stable(value: Any) -> str:
    """Compact JSON with keys in collation order, at every depth."""
    return json.dumps(_ordered(whole(value)), separators=(",", ":"), ensure_ascii=False)


def strings(value: Any) -> list[str]:
    """The words of a string or of nested lists of strings; other values have none."""
    if isinstance(value, list):
        return [x for v in value for x in strings(v)]
    return [x for x in SPACES.split(value) if x] if isinstance(value, str) else []


def shown(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return ", ".join(filter(None, map(shown, value)))
    return compact(value) if isinstance(value, dict) else str(whole(value))


def parse_yaml(text: str) -> dict:
    """A mapping of core-schema scalars; {} for anything else."""
    import yaml

    class Core(yaml.SafeLoader):
        """Booleans, integers, floats and nulls of YAML 1.2; no dates, no yes and no."""

    Core.yaml_implicit_resolvers = {}
    for tag, pattern, first in (
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
        ("int", r"^[-+]?[0-9]+$", "-+0123456789"),
        ("float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$", "-+0123456789."),
        ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ):
        Core.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), list(first))
    try:
        out = yaml.load(text, Loader=Core)  # noqa: S506 - a subclass of the safe loader
    except yaml.YAMLError:
        return {}
    return whole(out) if isinstance(out, dict) else {}


FRONTMATTER = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("frontmatter_json", "stable_json", "title", "status", "project", "type")]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("frontmatter_tags", "aliases", "frontmatter_keys")]
)


def described(raw: str | None) -> tuple:
    lines = (raw or "").split("\n")
    closed = lines[1:-1] if lines[-1].startswith("---") else lines[1:]
    fm = parse_yaml("\n".join(closed)) if raw else {}
    aliases = fm.get("aliases") if fm.get("aliases") is not None else fm.get("alias")
    tags = [t.removeprefix("#") for t in strings(fm.get("tags"))]
    return (compact(fm), stable(fm), *(shown(fm.get(k)) for k in ("title", "status", "project", "type")), tags, strings(aliases), list(fm))


@F.pandas_udf(FRONTMATTER)
def frontmatter(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([described(x) for x in raw], columns=FRONTMATTER.names)
