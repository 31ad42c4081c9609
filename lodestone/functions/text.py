"""Column functions on note texts, all built in."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space and line ends of ECMAScript, also as a character class.
WHITE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = f"[{WHITE}]"
EXCERPT = 700


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def unix_lines(c: Column) -> Column:
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def _close(n: Column) -> Column:
    """Where the closing fence's line break stands (from 1), 0 if there is none."""
    return F.when(F.startswith(n, F.lit("---\n")), F.locate("\n---", n, 5)).otherwise(F.lit(0))


def _after_close(n: Column) -> Column:
    """Where the line of the closing fence ends, 0 if the text ends with it."""
    return F.call_function("locate", F.lit("\n"), n, _close(n) + 4)


def body(content: Column) -> Column:
    """The text after the front matter; all of it where no closed front matter leads."""
    n = unix_lines(content)
    return F.when(_close(n) == 0, n).when(_after_close(n) == 0, F.lit("")).otherwise(F.substr(n, _after_close(n) + 1))


def raw_frontmatter(content: Column) -> Column:
    n = unix_lines(content)
    return F.when(_close(n) == 0, F.lit("")).when(_after_close(n) == 0, n).otherwise(F.substr(n, F.lit(1), _after_close(n) - 1))


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def config_hash(size: int, overlap: int) -> str:
    text = json.dumps({"chunkSize": size, "chunkOverlap": overlap, "indexedBody": "markdown-body-v1"}, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", "")


def bare_tag(tag: Column) -> Column:
    return F.regexp_replace(trim(tag), "^#", "")


def unique(values: Column) -> Column:
    """Trimmed, without empties and repeats, in collation order."""
    kept = F.array_distinct(F.filter(F.transform(values, trim), lambda x: x != ""))
    order = lambda a, b: F.when(F.collate(a, "UNICODE") < F.collate(b, "UNICODE"), -1).when(F.collate(a, "UNICODE") > F.collate(b, "UNICODE"), 1).otherwise(0)
    return F.array_sort(kept, order)


def inline_tags(text: Column) -> Column:
    return unique(F.regexp_extract_all(text, F.lit(f"(^|{SPACE})#([A-Za-z0-9/_-]+)"), F.lit(2)))


def list_text(values: Column) -> Column:
    """|a|b| in lower case, for substring filters; || for none."""
    return F.concat(F.lit("|"), F.array_join(F.transform(values, F.lower), "|"), F.lit("|"))


def excerpt(text: Column, size: int = EXCERPT) -> Column:
    return F.substring(text, 1, size)


def score_label(fused: Column, rerank_rank: Column, rerank: Column, vector_rank: Column, lexical_rank: Column, score: Column) -> Column:
    """How a result shows its scores: fused with its parts, else the plain score; halves of the decimal value round up."""
    parts = F.array_compact(F.array(
        F.when(rerank.isNotNull(), F.format_string("r%.2f", rerank)),
        F.when(vector_rank.isNotNull(), F.format_string("v#%d", vector_rank)),
        F.when(lexical_rank.isNotNull(), F.format_string("bm25#%d", lexical_rank)),
    ))
    tail = F.when(F.size(parts) > 0, F.concat(F.lit(" ("), F.array_join(parts, " "), F.lit(")"))).otherwise(F.lit(""))
    return F.when(fused.isNotNull(), F.concat(F.format_string("rrf %.4f", fused), tail)).otherwise(F.format_string("score %.3f", score))


def is_path_query(text: Column) -> Column:
    """Whether a text begins with a path query's keyword; only ASCII letters, digits and _ go on with a word."""
    return F.rlike(trim(text), F.lit(r"(?i)^(LIST|TABLE|TASK|CALENDAR)(?![A-Za-z0-9_])"))
