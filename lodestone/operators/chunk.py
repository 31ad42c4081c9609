"""Cutting note bodies into overlapping chunks: a table function by built-in expressions.

Chunk i begins at i * step, whatever earlier chunks ended at, so all are cut at
once, without recursion or a shuffle. A chunk that is not the last ends at the last
blank line in its second half, if there is one, which can leave a gap before the
next; ``gapless`` ends every chunk at its full size instead. Lengths are code points.
Time is in proportion to the text, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import trim, unix_lines

BREAK = "\n\n"


def slices(clean: Column, size: int, overlap: int, gapless: bool = False) -> Column:
    """The non-empty trimmed chunks of a trimmed text, in order.

    The text is cut once into pieces of one step; a chunk and the break behind it lie
    within the few pieces from its own on, so no chunk walks the text from its start.
    """
    step, half, n = max(1, size - overlap), size // 2, F.length(clean)
    reach = -(-(size + len(BREAK)) // step)
    count = F.when(n <= size, 1).otherwise((1 + F.ceil((n - size) / F.lit(float(step)))).cast("int"))

    def one(near: Column) -> Column:
        have = F.length(near)
        stop = F.least(have, F.lit(size))
        seen = F.substr(near, F.lit(half + 2), stop + len(BREAK) - (half + 1))
        back = F.locate(BREAK, F.reverse(seen))
        at_break = half + 1 + F.length(seen) - back - 1
        end = stop if gapless else F.when((stop < have) & (back > 0), at_break).otherwise(stop)
        return trim(F.substr(near, F.lit(1), end))

    pieces = F.array(F.regexp_extract_all(clean, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)))
    near = lambda all_: F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(all_, i, reach), ""))
    cut = F.transform(F.flatten(F.transform(pieces, near)), one)  # as a lambda's argument, the pieces are cut but once
    return F.when(n > 0, F.filter(cut, lambda c: c != "")).otherwise(F.array().cast("array<string>"))


def chunk(notes: DataFrame, size: int, overlap: int, gapless: bool = False, body: str = "body", body_hash: str = "body_hash") -> DataFrame:
    """A row for each chunk: the note's other columns, position, text and id."""
    keep = [c for c in notes.columns if c != body]
    cut = notes.withColumn("clean", trim(unix_lines(F.col(body))))
    rows = cut.select(*keep, F.posexplode(slices(F.col("clean"), size, overlap, gapless)).alias("position", "text"))
    return rows.withColumn("id", F.concat_ws("#", "path", F.substring(body_hash, 1, 12), F.col("position").cast("string")))
