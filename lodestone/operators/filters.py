"""Predicates of a search; all of them must hold."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALARS = ("status", "project", "type", "title")
#: An escape character that texts do not hold, so backslashes are literal.
NO_ESCAPE = "\x01"


def like(col: Column, pattern: str) -> Column:
    return F.like(col, F.lit(pattern), F.lit(NO_ESCAPE))


#: What a user's predicate may be made of: kinds of expressions, and names of functions.
KINDS = frozenset(
    "And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual In Like ILike LikeAny LikeAll NotLikeAny NotLikeAll RLike IsNull IsNotNull "
    "Literal UnresolvedAttribute UnresolvedExtractValue Cast Concat CaseWhen Add Subtract Multiply Divide Remainder UnaryMinus UnaryPositive "
    "Substring StringTrim StringTrimLeft StringTrimRight StringTrimBoth StringLocate UnresolvedFunction".split()
)
FUNCTIONS = frozenset(
    "between lower lcase upper ucase length char_length trim ltrim rtrim substr substring substring_index left right concat concat_ws contains startswith endswith instr locate position "
    "replace coalesce nullif ifnull nvl if abs round floor ceil greatest least size cardinality array array_contains arrays_overlap get_json_object regexp_like mod isnull isnotnull".split()
)


def where_text(spark: SparkSession, text: str) -> Column:
    """A user's predicate, parsed on its own so that it cannot reach the other clauses.

    Columns, literals, comparisons, boolean and arithmetic operators and the functions
    named above; anything else, such as a subquery or a call into the JVM, is a ValueError.
    """
    todo = [spark._jsparkSession.sessionState().sqlParser().parseExpression(text.strip())]
    while todo:
        e = todo.pop()
        kind = e.getClass().getSimpleName()
        if kind not in KINDS:
            raise ValueError(f"{kind} is not allowed in where")
        if kind == "UnresolvedFunction" and (name := e.nameParts().mkString(".")).lower() not in FUNCTIONS:
            raise ValueError(f"the function {name} is not allowed in where")
        below = e.children()
        todo += [below.apply(i) for i in range(below.size())]
    return F.expr(text.strip())


def tag(name: str, strict: bool = False) -> Column | None:
    """Notes with a tag, whatever its case; wildcards work unless ``strict``."""
    bare = name.strip().removeprefix("#").lower()
    if not bare:
        return None
    return F.array_contains(F.transform("tags", F.lower), bare) if strict else like(F.col("tags_text"), f"%|{bare}|%")


def text_of(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else ("null" if value is None else f"{value:g}" if isinstance(value, float) else str(value))


def frontmatter(key: str, value: Any, strict: bool = False) -> Column:
    """A front matter value: exact for the promoted columns, else a match in its JSON text."""
    if key in SCALARS:
        return F.col(key) == text_of(value)
    if strict:
        return F.get_json_object("frontmatter_json", f"$['{key}']") == text_of(value)
    return like(F.col("frontmatter_json"), f'%"{key}":{json.dumps(value, separators=(",", ":"), ensure_ascii=False)}%')


def at_path(path: str) -> Column:
    return F.col("path") == F.lit(path)


def predicate(spark: SparkSession, where: str | None = None, tags: tuple[str, ...] = (), fm: dict[str, Any] | None = None, strict: bool = False) -> Column | None:
    found = [where_text(spark, where)] if where and where.strip() else []
    found += [c for t in tags if (c := tag(t, strict)) is not None]
    found += [frontmatter(k, v, strict) for k, v in (fm or {}).items()]
    return reduce(Column.__and__, found) if found else None


def narrowed(rows: DataFrame, where: str | None = None, tags: tuple[str, ...] = (), fm: dict[str, Any] | None = None, paths: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Rows that satisfy all; ``paths`` (a column path) None filters nothing, empty keeps nothing.

    The planner broadcasts ``paths`` where its size allows and shuffles it otherwise.
    """
    p = predicate(rows.sparkSession, where, tags, fm, strict)
    out = rows if p is None else rows.where(p)
    return out if paths is None else out.join(paths.select("path").distinct(), "path", "left_semi")
