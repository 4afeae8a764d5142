"""What changed: file state, chunk differences, stale rows, resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a chunk is the same by; its content isn't part of it.
IDENTITY = ("file_path", "symbol_name", "symbol_kind", "parent", "signature", "role", "byte_start", "byte_end")


def changed_files(files: DataFrame, state: DataFrame, *, by: tuple[str, ...] = ("file_mtime", "file_size")) -> DataFrame:
    """Files that aren't in the state with the same path and columns `by`; nulls are equal."""
    s = state.select(F.col("file_path").alias("_path"), *[F.col(c).alias(f"_{c}") for c in by])
    same = F.col("file_path") == F.col("_path")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return files.join(s, same, "left_anti")


def unchanged_files(files: DataFrame, state: DataFrame, *, by: tuple[str, ...] = ("file_mtime", "file_size")) -> DataFrame:
    s = state.select(F.col("file_path").alias("_path"), *[F.col(c).alias(f"_{c}") for c in by])
    same = F.col("file_path") == F.col("_path")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return files.join(s, same, "left_semi")


def missing_paths(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Paths expected but not found."""
    return expected.select("file_path").distinct().join(found.select("file_path").distinct(), "file_path", "left_anti")


stale_paths = missing_paths


def identity_minus(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = IDENTITY) -> DataFrame:
    return a.join(b.select(*[F.col(k).alias(f"_{k}") for k in keys]), _same(keys), "left_anti")


def identity_intersect(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = IDENTITY) -> DataFrame:
    return a.join(b.select(*[F.col(k).alias(f"_{k}") for k in keys]), _same(keys), "left_semi")


def _same(keys: tuple[str, ...]) -> Column:
    out = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = c if out is None else out & c
    return out


def diff(old: DataFrame, new: DataFrame, *, keys: tuple[str, ...] = IDENTITY, content: str = "file_hash") -> DataFrame:
    """The keys with status added, deleted, modified or unchanged: one full outer join on null-safe keys.

    content: the column that tells unchanged from modified. The whole file's hash marks every chunk of an edited file as
    modified; the chunk's own source only those that differ.
    """
    a = old.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(content).alias("_old"), F.lit(1).alias("_in_old"))
    b = new.select(*keys, F.col(content).alias("_new"), F.lit(1).alias("_in_new"))
    joined = a.join(b, _same(keys), "full_outer")
    status = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("modified")
    return joined.select(*[F.coalesce(F.col(k), F.col(f"_{k}")).alias(k) for k in keys], status.alias("status"))


def resume_pending(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """(file_path, file_hash, chunk_count, status): completed where the stored hash and count are those expected, else
    pending. Files expected to have no chunks are delete_only while something is stored, else completed."""
    s = stored.select(F.col("file_path").alias("_p"), F.col("file_hash").alias("_h"), "point_count")
    joined = expected.join(s, F.col("file_path") == F.col("_p"), "left")
    done = (F.col("file_hash") == F.col("_h")) & (F.col("point_count") == F.col("chunk_count"))
    status = F.when((F.col("chunk_count") == 0) & F.col("_p").isNotNull(), "delete_only").when(F.col("chunk_count") == 0, "completed").when(F.coalesce(done, F.lit(False)), "completed").otherwise("pending")
    return joined.select("file_path", "file_hash", "chunk_count", status.alias("status"))


def resume_plan(changed: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_path, file_hash, chunk_count) of changed files."""
    counted = chunks.groupBy("file_path").agg(F.count(F.lit(1)).alias("chunk_count"))
    return changed.select("file_path", "file_hash").join(counted, "file_path", "left").na.fill(0, ["chunk_count"])


def file_signature(size: Column, mtime: Column) -> Column:
    """A cheap key that changes with size or time."""
    return F.xxhash64(size, mtime)


def refresh(points: DataFrame, new_chunks: DataFrame, touched: DataFrame) -> DataFrame:
    """The points after a refresh: those of touched files (file_path) replaced by their new chunks."""
    return points.join(touched.select("file_path").distinct(), "file_path", "left_anti").unionByName(new_chunks, allowMissingColumns=True)


def index_stats(stages: DataFrame) -> DataFrame:
    """Adds up metrics of stages (stage, metric, value): sums, and the largest for peaks."""
    return stages.groupBy("stage", "metric").agg(F.when(F.first("metric").startswith("peak_"), F.max("value")).otherwise(F.sum("value")).alias("value"))
