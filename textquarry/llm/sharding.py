"""Weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import fresh, key_string, unit, unit_sql

#: Sixteen shards; every fourth one holds twice as much.
SHARDS: dict[int, float] = {i: 2.0 if i % 4 == 3 else 1.0 for i in range(16)}


def shard_of(keys: Sequence[str], shards: Mapping[int, float], seed: int = 0) -> Column:
    """The shard of a record: the one with the least -ln(u) / weight, where u in (0, 1) is a hash of key and shard.

    A shard gets records in proportion to its weight. Adding a shard moves only the records that the new one wins;
    removing one moves only its own. Shards of weight 0 or less get nothing. A null key counts as the key ``\\N``, so
    all records without key share a shard; equal keys always do. Ties go to the lower shard number.
    """
    live = [(int(k), float(w)) for k, w in sorted(shards.items()) if w > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    key = F.concat_ws("\x1f", *[key_string(k) for k in keys])
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in live])
    scores = F.transform(table, lambda s: F.struct((-F.log(unit(F.lit(str(seed)), s["k"].cast("string"), key)) / s["w"]).alias("score"), s["k"].alias("k")))
    return F.array_min(scores)["k"]


def assign(docs: DataFrame, shards: Mapping[int, float] = SHARDS, keys: Sequence[str] = ("doc_id",), seed: int = 0, out: str = "shard") -> DataFrame:
    """All rows and columns with the column `out`; a column of that name is replaced. No shuffle.

    Nulls in keys, repeated rows: see shard_of. An empty table stays empty. Texts aren't read.
    """
    (tmp,) = fresh(docs.columns, "shard_tmp")
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    return docs.withColumn(tmp, shard_of(keys, shards, seed)).select(*[F.col(f"`{c}`") for c in kept], F.col(tmp).alias(out))


def write_shards(docs: DataFrame, path: str, shards: Mapping[int, float] = SHARDS, keys: Sequence[str] = ("doc_id",), seed: int = 0) -> None:
    """Writes one folder a shard."""
    done = assign(docs, shards, keys, seed)
    done.repartition(len(shards), "shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def assign_sql(table: str, columns: str, shards: Mapping[int, float] = SHARDS, seed: int = 0) -> str:
    rows = ", ".join(f"({k}, {float(w)!r}::DOUBLE)" for k, w in sorted(shards.items()) if w > 0)
    u = unit_sql(f"'{seed}'", "s.k::VARCHAR", "coalesce(d.doc_id::VARCHAR, '\\N')")
    return (
        f"SELECT {columns}, (SELECT s.k FROM (VALUES {rows}) s(k, w) ORDER BY -ln({u}) / s.w, s.k LIMIT 1)::INTEGER AS shard FROM {table} d"
    )
