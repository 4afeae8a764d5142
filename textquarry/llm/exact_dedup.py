"""Exact duplicates by counting quotient filters, then byte for byte."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import Tables, content_id, small

U64 = np.uint64


def encode(values: np.ndarray, counts: np.ndarray, prefix_bits: int) -> bytes:
    """A counting quotient filter of sorted distinct 64-bit fingerprints that share their first prefix_bits bits.

    The next q bits are the quotient: it names the home slot; the rest, the remainder, is what a slot holds. Remainders
    of a quotient form a run, runs follow one another by linear probing. Two bit vectors (which quotients occur, where
    runs end) make the fingerprints recoverable. Counts above one are kept by slot.
    """
    n = values.size
    q = max(1, int(np.ceil(np.log2(max(n, 1) / 0.75))))
    r = 64 - prefix_bits - q
    low = values & U64((1 << (64 - prefix_bits)) - 1)
    quotient = (low >> U64(r)).astype(np.int64)
    remainder = low & U64((1 << r) - 1)
    order = np.arange(n)
    slot = order + np.maximum.accumulate(quotient - order) if n else order
    slots = max(1 << q, int(slot[-1]) + 1) if n else 1 << q
    occupied, ends = np.zeros(1 << q, bool), np.zeros(slots, bool)
    occupied[quotient] = True
    ends[slot[np.append(quotient[1:] != quotient[:-1], True)] if n else slot] = True
    width = (r + 7) // 8
    body = np.zeros((slots, width), np.uint8)
    body[slot] = remainder.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    used = np.zeros(slots, bool)
    used[slot] = True
    many = np.flatnonzero(counts > 1)
    head = np.array([prefix_bits, q, slots, n, int(values[0] >> U64(64 - prefix_bits)) if n and prefix_bits else 0, many.size], "<i8")
    return b"".join([head.tobytes(), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), np.packbits(used).tobytes(), body.tobytes(), slot[many].astype("<i8").tobytes(), counts[many].astype("<i8").tobytes()])


def decode(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints of a filter, and their counts."""
    prefix_bits, q, slots, n, prefix, many = np.frombuffer(blob, "<i8", 6).tolist()
    at = 48

    def bits(size: int) -> np.ndarray:
        nonlocal at
        out = np.unpackbits(np.frombuffer(blob, np.uint8, (size + 7) // 8, at), count=size).astype(bool)
        at += (size + 7) // 8
        return out

    occupied, ends, used = bits(1 << q), bits(slots), bits(slots)
    r = 64 - prefix_bits - q
    width = (r + 7) // 8
    body = np.frombuffer(blob, np.uint8, slots * width, at).reshape(slots, width)
    at += slots * width
    where = np.flatnonzero(used)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = body[where]
    run = np.cumsum(ends[where]) - ends[where]
    quotient = np.flatnonzero(occupied)[run].astype(U64)
    values = (quotient << U64(r)) | wide.reshape(-1).view("<u8").astype(U64)
    if prefix_bits:
        values |= U64(prefix) << U64(64 - prefix_bits)
    counts = np.ones(n, np.int64)
    slot = np.frombuffer(blob, "<i8", many, at)
    counts[np.searchsorted(where, slot)] = np.frombuffer(blob, "<i8", many, at + 8 * many)
    return values, counts


def merge(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted union of filters, counts added: nothing is lost."""
    parts = [decode(b) for b in blobs]
    values = np.concatenate([np.zeros(0, U64), *[v for v, _ in parts]])
    counts = np.concatenate([np.zeros(0, np.int64), *[c for _, c in parts]])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    if not values.size:
        return values, counts
    head = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[head], np.add.reduceat(counts, head)


def fingerprint_counts(fingerprints: DataFrame, prefix_bits: int) -> DataFrame:
    """Fingerprints (column fp) that occur more than once, with counts: filters built by partition, merged by prefix."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).drop_null().to_numpy(zero_copy_only=False).view(U64) for b in batches]
        values, counts = np.unique(np.concatenate([np.zeros(0, U64), *parts]), return_counts=True)
        prefix = (values >> U64(64 - prefix_bits)).astype(np.int32) if prefix_bits else np.zeros(values.size, np.int32)
        cuts = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])) if values.size else np.zeros(0, np.int64)
        rows = [(int(prefix[a]), encode(values[a:b], counts[a:b], prefix_bits)) for a, b in zip(cuts, np.append(cuts[1:], values.size))]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["prefix", "filter"])

    def combine(table: pa.Table) -> pa.Table:
        values, counts = merge(table.column("filter").to_pylist())
        heavy = counts > 1
        return pa.table({"fp": values[heavy].view(np.int64), "n": counts[heavy]})

    filters = fingerprints.select("fp").mapInArrow(build, "prefix int, filter binary")
    return filters.groupBy("prefix").applyInArrow(combine, "fp long, n long")


def duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row whose text occurs more than once: doc_id, keep_id (least doc_id with that text), copies.

    Fingerprints only route: equal ones are compared as whole texts. Null texts are no one's copies; empty texts are
    copies of each other. Repeated rows count one by one. A null key stays null in doc_id and loses against any other
    for keep_id. Other columns aren't read. An empty table gives no rows.

    Moved: a filter slot a row; then only texts whose fingerprint occurs twice. What is broadcast is counted before.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "exact")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    prefix_bits = max(4, (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    heavy = tables.write(fingerprint_counts(rows.select(content_id("text").alias("fp")), prefix_bits).select("fp"))
    routed = rows.withColumn("fp", content_id("text")).join(small(heavy, 16), "fp", "left_semi")
    groups = routed.groupBy("fp", "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    back = routed.join(groups, ["fp", "text"])
    return back.select("doc_id", "keep_id", "copies")


SQL = """SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS copies
FROM documents WHERE text IS NOT NULL QUALIFY count(*) OVER (PARTITION BY text) > 1"""
