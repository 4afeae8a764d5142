"""Reading and editing texts by lines, with hash guards and undo; nothing is written in place."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_lines(files: DataFrame, path: str, start: int = 1, end: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """(file_path, text, line_start, line_end, total_lines, truncated): lines from 1, both ends included."""
    lines = F.split("text", "\n")
    total = F.size(lines)
    stop = F.least(F.lit(end), total) if end else total
    part = F.array_join(F.slice(lines, max(start, 1), F.greatest(stop - max(start, 1) + 1, F.lit(0))), "\n")
    cut = F.octet_length(part) > max_bytes if max_bytes else F.lit(False)
    shown = F.regexp_replace(F.decode(F.substring(F.encode(part, "UTF-8"), 1, max_bytes), "UTF-8"), "�+$", "") if max_bytes else part
    return files.where(F.col("file_path") == path).select("file_path", F.when(cut, shown).otherwise(part).alias("text"), F.lit(max(start, 1)).alias("line_start"), stop.alias("line_end"), total.alias("total_lines"), cut.alias("truncated"))


@dataclass(frozen=True)
class Edit:
    """mode: append, insert (before line `start`) or replace (lines start to end, from 1, both included)."""

    mode: str
    text: str
    start: int = 0
    end: int = 0


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def apply(text: str, edits: list[Edit], expected: str | None = None) -> str:
    """The edited text. Line numbers are those of the text before; overlapping replacements and a wrong hash raise."""
    if expected is not None and expected != sha256(text):
        raise ValueError("the text isn't the one that was expected")
    lines = text.split("\n")
    placed = []
    for i, e in enumerate(edits):
        if e.mode == "append":
            placed.append((len(lines), len(lines), i, e.text.split("\n")))
        elif e.mode == "insert" and 1 <= e.start <= len(lines) + 1:
            placed.append((e.start - 1, e.start - 1, i, e.text.split("\n")))
        elif e.mode == "replace" and 1 <= e.start <= e.end <= len(lines):
            placed.append((e.start - 1, e.end, i, e.text.split("\n") if e.text else []))
        else:
            raise ValueError(f"no such lines: {e}")
    placed.sort()
    for a, b in zip(placed, placed[1:]):
        if b[0] < a[1]:
            raise ValueError("edits overlap")
    for begin, end, _, new in reversed(placed):
        lines[begin:end] = new
    return "\n".join(lines)


def edit(files: DataFrame, path: str, edits: list[Edit], expected: str | None = None, edit_id: str = "edit") -> tuple[DataFrame, DataFrame]:
    """The files with the one at `path` edited, and the undo row (edit_id, file_path, before, after_hash)."""
    found = files.where(F.col("file_path") == path).select("text").take(2)
    if len(found) != 1:
        raise ValueError(f"{len(found)} files at {path}")
    after = apply(found[0][0], edits, expected)
    new = files.withColumn("text", F.when(F.col("file_path") == path, F.lit(after)).otherwise(F.col("text")))
    undo = files.sparkSession.createDataFrame([(edit_id, path, found[0][0], sha256(after))], "edit_id string, file_path string, before string, after_hash string")
    return new, undo


def revert(files: DataFrame, undo: DataFrame, edit_id: str) -> DataFrame:
    """The files with that edit taken back where their text is still what it made."""
    u = undo.where(F.col("edit_id") == edit_id).select(F.col("file_path").alias("_p"), "before", "after_hash")
    joined = files.join(F.broadcast(u), (F.col("file_path") == F.col("_p")) & (F.sha2("text", 256) == F.col("after_hash")), "left")
    return joined.withColumn("text", F.coalesce("before", "text")).select(*files.columns)


def replace_lines(text: Column, start: Column, end: Column, new: Column) -> Column:
    """Lines start to end (from 1) replaced, for many rows at once."""
    lines = F.split(text, "\n")
    return F.array_join(F.concat(F.slice(lines, F.lit(1), F.greatest(start - 1, F.lit(0))), F.array(new), F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0)))), "\n")


def edit_symbols(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """files with the sources of symbols (file_path, line_start, line_end, new_source; one a file) replaced."""
    s = symbols.select("file_path", "line_start", "line_end", "new_source")
    joined = files.join(s, "file_path", "left")
    new = replace_lines(F.col("text"), F.col("line_start").cast("int"), F.col("line_end").cast("int"), F.col("new_source"))
    return joined.withColumn("text", F.when(F.col("new_source").isNotNull(), new).otherwise(F.col("text"))).select(*files.columns)
