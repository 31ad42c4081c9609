"""Path sets: which notes a source or a query names. The grammar is our own.

source: #tag, "folder", and, or, - (not), parentheses.
query: LIST|TABLE|TASK|CALENDAR ... [FROM source] [WHERE key op value {AND|OR ...}].
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.filters import SCALARS

TOKEN = re.compile(r'\s*(?:(#[\w/-]+)|"([^"]*)"|(\(|\))|(!=|>=|<=|=|>|<)|(-)(?=[#"(])|([^\s()"=<>!]+))')
COMMANDS = ("LIST", "TABLE", "TASK", "CALENDAR")
OPS: dict[str, Callable[[Column, Column], Column]] = {"=": Column.__eq__, "!=": Column.__ne__, ">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__}


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"cannot read {text[at:]!r}")
        kind = ("tag", "string", "paren", "op", "not", "word")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


class _Reader:
    def __init__(self, tokens: list[tuple[str, str]], atom: Callable[["_Reader"], Column]):
        self.tokens, self.atom = tokens, atom

    def take(self) -> tuple[str, str]:
        if not self.tokens:
            raise ValueError("the expression ends too soon")
        return self.tokens.pop(0)

    def word(self, value: str) -> bool:
        if self.tokens and self.tokens[0][0] == "word" and self.tokens[0][1].lower() == value:
            self.tokens.pop(0)
            return True
        return False

    def either(self) -> Column:
        out = self.both()
        while self.word("or"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while self.word("and"):
            out = out & self.one()
        return out

    def one(self) -> Column:
        if self.tokens and self.tokens[0][0] == "not":
            self.tokens.pop(0)
            return ~self.one()
        if self.tokens and self.tokens[0] == ("paren", "("):
            self.tokens.pop(0)
            out = self.either()
            if self.take() != ("paren", ")"):
                raise ValueError("a parenthesis is not closed")
            return out
        return self.atom(self)


def _place(r: _Reader) -> Column:
    kind, value = r.take()
    if kind == "tag":
        low = value[1:].lower()
        return F.exists("tags", lambda t: (F.lower(t) == low) | F.startswith(F.lower(t), F.lit(low + "/")))
    if kind == "string":
        return (F.col("path") == value) | (F.col("path") == value + ".md") | F.startswith("path", F.lit(value.rstrip("/") + "/"))
    raise ValueError(f"{value!r} is no source")


def _test(r: _Reader) -> Column:
    (kind, key), (op_kind, op), (_, value) = r.take(), r.take(), r.take()
    if kind != "word" or op_kind != "op":
        raise ValueError(f"{key!r} is no comparison")
    col = F.col(key) if key in SCALARS else F.get_json_object("frontmatter_json", f"$['{key}']")
    number = re.fullmatch(r"-?\d+(\.\d+)?", value)
    return OPS[op](col.try_cast("double"), F.lit(float(value))) if number and key not in SCALARS else OPS[op](col, F.lit(value))


def _whole(tokens: list[tuple[str, str]], atom: Callable[[_Reader], Column]) -> Column:
    r = _Reader(tokens, atom)
    out = r.either()
    if r.tokens:
        raise ValueError(f"unexpected {r.tokens[0][1]!r}")
    return out


def source_predicate(source: str) -> Column:
    return _whole(_tokens(source), _place)


def query_predicate(query: str) -> Column:
    tokens = _tokens(query)
    if not tokens or tokens[0][1].upper() not in COMMANDS:
        raise ValueError("Path query failed.")
    words = [t[1].lower() if t[0] == "word" else "" for t in tokens]
    where = words.index("where") if "where" in words else len(tokens)
    out = F.lit(True)
    if "from" in words[:where]:
        out = out & _whole(tokens[words.index("from") + 1 : where], _place)
    return out & _whole(tokens[where + 1 :], _test) if where < len(tokens) else out


class NotesProvider:
    """Resolves sources and queries over a frame of notes (path, tags, front matter)."""

    def __init__(self, notes: DataFrame):
        self.notes = notes

    def by_source(self, source: str) -> DataFrame:
        return self.notes.where(source_predicate(source)).select("path").distinct()

    def by_query(self, query: str) -> DataFrame:
        return self.notes.where(query_predicate(query)).select("path").distinct()


def resolve(provider: NotesProvider | None, source: str | None, query: str | None) -> DataFrame | None:
    """The paths named; None, which filters nothing, without a provider or a name. A query goes before a source."""
    if provider is None:
        return None
    if query and query.strip():
        return provider.by_query(query)
    return provider.by_source(source) if source and source.strip() else None
