"""Nearest neighbours over vector columns, fusion and reordering of ranked lists."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textquarry.functions import tokens as T

RRF_K, FIRST, SECOND = 60, 0.05, 0.02
#: So many queries go to every task in one pass over the points; about so many vectors of a set are in one block.
QUERY_ROWS, BLOCK_ROWS = 10_000, 2000


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def euclid(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def normalised(a: str | Column) -> Column:
    size = norm(a)
    return F.when(size > 0, F.transform(_col(a), lambda x: x.cast("double") / size)).otherwise(_col(a).cast("array<double>"))


#: Metric -> column of two vectors, and whether more is better.
METRICS = {"cosine": (cosine, True), "dot": (dot, True), "euclid": (euclid, False)}


def _matrix(vectors: list) -> np.ndarray:
    return np.array([list(v) for v in vectors], np.float64).reshape(len(vectors), -1)


def scores(metric: str, points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Points by queries, as cosine, dot and euclid say."""
    if metric == "euclid":  # differences, not products: small distances stay exact
        return np.stack([np.sqrt(((points - q) ** 2).sum(axis=1)) for q in queries], axis=1) if len(queries) else np.zeros((len(points), 0))
    product = points @ queries.T
    if metric == "cosine":
        size = np.sqrt((points**2).sum(axis=1))[:, None] * np.sqrt((queries**2).sum(axis=1))
        product = np.divide(product, size, out=np.zeros_like(product), where=size > 0)
    return product


def knn(points: DataFrame, queries: DataFrame, k: int, *, metric: str = "cosine", vector: str = "embedding", key: str = "vec_id", where: Column | None = None, apart: str | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k best points of each query, exactly; scores count to nine places, ties by key.

    queries: (query_id, query_vector). A block of at most QUERY_ROWS of them goes to every task, which multiplies batches
    of points with all of it and keeps the k best of each query; so k rows a query and task are shuffled. More queries
    make more passes. Points without a vector have no rank; nor have those whose column `apart` is the query's id.
    """
    more = METRICS[metric][1]
    asked = queries.select("query_id", "query_vector").where(F.col("query_vector").isNotNull())
    passes = max(1, -(-asked.count() // QUERY_ROWS))
    held = points.where(F.col(vector).isNotNull() if where is None else where & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"), (F.col(apart) if apart else F.lit(None)).cast("string").alias("g"))
    types = [asked.schema["query_id"].dataType, held.schema["key"].dataType]
    kinds, arrow = [t.simpleString() for t in types], [to_arrow_type(t) for t in types]
    found = None
    for no in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(passes)) == no).collect()
        shared = points.sparkSession.sparkContext.broadcast(([r[0] for r in rows], _matrix([r[1] for r in rows])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, block = shared.value
            best: list[list[tuple]] = [[] for _ in names]
            for batch in batches:
                if not batch.num_rows or not names:
                    continue
                lists = batch.column(1)
                rated = scores(metric, lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1), block)
                ranked = np.round(rated, 9) * (-1 if more else 1)
                groups = np.array(batch.column(2).to_pylist(), object)
                for q, name in enumerate(names):
                    at = np.flatnonzero(groups != str(name))
                    if at.size > k:  # all that tie with the k-th stay until keys decide
                        column = ranked[at, q]
                        at = at[column <= np.partition(column, k - 1)[k - 1]]
                    column = ranked[:, q]
                    keys = batch.column(0).take(pa.array(at)).to_pylist()
                    best[q] = sorted([*best[q], *zip(column[at].tolist(), keys, rated[at, q].tolist())], key=lambda x: x[:2])[:k]
            flat = [(n, x) for n, b in zip(names, best) for x in b]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in flat], arrow[0]), pa.array([x[1] for _, x in flat], arrow[1]), pa.array([x[2] for _, x in flat], pa.float64())], ["query_id", "key", "score"])

        part = held.mapInArrow(run, f"query_id {kinds[0]}, key {kinds[1]}, score double")
        found = part if found is None else found.unionByName(part)
    near = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)) if more else F.asc(F.round("score", 9)), "key")
    ranked = found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("key").alias(key), "score", "rank")


def maxsim_of_sets(points: DataFrame, queries: DataFrame, *, vector: str = "embedding", key: str = "vec_id", group: str = "label", block: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, group, score): late interaction of each set of query vectors with each group of points.

    queries: (query_id, key, query_vector), a stated set. Both sides are packed into blocks of about `block` vectors; each
    pair of blocks is one matrix product, of which the best a query vector and group go on.
    """

    def packed(df: DataFrame, names: list[str], prefix: str) -> DataFrame:
        n = max(1, -(-df.count() // block))
        rows = df.groupBy(F.pmod(F.xxhash64(names[1], F.lit(5)), F.lit(n)).alias("no")).agg(F.collect_list(F.struct(*names)).alias("rows"))
        return rows.select(*[F.col(f"rows.{x}").alias(prefix + str(i)) for i, x in enumerate(names)])

    q = packed(queries.where(F.col("query_vector").isNotNull()), ["query_id", key, "query_vector"], "q")
    p = packed(points.where(F.col(vector).isNotNull()), [group, key, vector], "p")
    types = [queries.schema["query_id"].dataType, queries.schema[key].dataType, points.schema[group].dataType]
    kinds, arrow = [t.simpleString() for t in types], [to_arrow_type(t) for t in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                product = _matrix(r["p2"]) @ _matrix(r["q2"]).T
                labels = sorted(set(r["p0"]))
                place = np.array([labels.index(x) for x in r["p0"]])
                best = np.full((len(labels), product.shape[1]), -np.inf)
                np.maximum.at(best, place, product)
                ids, keys = np.repeat(np.arange(len(r["q0"])), len(labels)), labels * len(r["q0"])
                yield pa.RecordBatch.from_arrays([pa.array([r["q0"][i] for i in ids], arrow[0]), pa.array([r["q1"][i] for i in ids], arrow[1]), pa.array(keys, arrow[2]), pa.array(best.T.reshape(-1))], ["query_id", "q", "label", "d"])

    pairs = q.crossJoin(p).repartition(F.xxhash64("q1", "p1"))  # blocks of vectors, each pair a task's work
    best = pairs.mapInArrow(run, f"query_id {kinds[0]}, q {kinds[1]}, label {kinds[2]}, d double").groupBy("query_id", "q", "label").agg(F.max("d").alias("d"))
    return best.groupBy("query_id", F.col("label").alias(group)).agg(F.sum("d").alias("score"))


def maxsim(query_tokens: str | Column, doc_tokens: str | Column) -> Column:
    """Late interaction: for each query vector its best dot product with a vector of the document, added up."""
    return F.aggregate(F.transform(_col(query_tokens), lambda q: F.array_max(F.transform(_col(doc_tokens), lambda d: dot(q, d)))), F.lit(0.0), lambda s, x: s + x)


def rrf(lists: DataFrame, weights: dict[int, float] | None = None, *, key: str = "key", k: int = RRF_K) -> DataFrame:
    """(query_id, key, score) of ranked lists (query_id, list, key, rank from 1[, score, kind]): sum of weight / (k + rank),
    with a bonus for the first and the next two places; in list 1 an artifact among the first three gets a little more."""
    table = F.create_map(*[F.lit(x) for pair in (weights or {0: 1.0}).items() for x in pair])
    weight = F.coalesce(F.element_at(table, F.col("list")), F.lit(1.0))
    score = weight / (F.lit(float(k)) + F.col("rank")) + F.when(F.col("rank") == 1, FIRST).when(F.col("rank") <= 3, SECOND).otherwise(0.0)
    if {"score", "kind"} <= set(lists.columns):
        artifact = (F.col("list") == 1) & (F.lower("kind") == "file_artifact") & (F.col("rank") <= 3)
        score = score + F.when(artifact, F.least(F.greatest(F.col("score"), F.lit(0.0)) * 0.05, F.lit(0.025))).otherwise(0.0)
    return lists.select("query_id", key, score.alias("s")).groupBy("query_id", key).agg(F.sum("s").alias("score"))


def ranked(df: DataFrame, *, key: str = "key", by: str = "query_id") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key)))


def rerank_blend(results: DataFrame, *, key: str = "key", retrieval: str = "score", rerank: str = "rerank_score", by: str = "query_id") -> DataFrame:
    """score by place: .75 of the retrieval score for the first three, .60 up to ten, .40 beyond; the rest of the
    reranker's score over its largest."""
    order = Window.partitionBy(by).orderBy(F.desc(retrieval), key)
    top = F.max(rerank).over(Window.partitionBy(by))
    share = F.coalesce(F.col(rerank) / F.when(top > 0, top).otherwise(F.lit(1.0)), F.lit(0.0))
    place = F.row_number().over(order)
    weight = F.when(place <= 3, 0.75).when(place <= 10, 0.60).otherwise(0.40)
    return results.withColumn("blended", F.col(retrieval) * weight + share * (F.lit(1.0) - weight))


def diversify(results: DataFrame, limit: int, *, group: str = "file_path", key: str = "key", by: str = "query_id", many_keywords: bool = True) -> DataFrame:
    """The first of each group first, then the others, each in order of rank; only for queries of many keywords."""
    if not many_keywords:
        return results.where(F.col("rank") <= limit).withColumn("place", F.col("rank"))
    again = F.row_number().over(Window.partitionBy(by, group).orderBy("rank", key)) > 1
    placed = results.withColumn("again", again)
    return placed.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("again", "rank", key))).where(F.col("place") <= limit).drop("again")


def overfetch(limit: int, keywords: int = 0, *, rerank: bool = False, path_filter: bool = False, hybrid: bool = False) -> int:
    """How many candidates to take for `limit` results."""
    if hybrid:
        return max(3 * limit, 18 if keywords >= 15 else 16)
    return limit * (10 if path_filter else 5 if rerank else 3 if keywords else 1)


def keyword_blend(score: Column, overlap: Column, weight: float = 0.3) -> Column:
    return score * (1.0 - weight) + overlap * weight


def payload_filter(*, language: str | None = None, path: str | None = None, prefix: str | None = None, kinds: list[str] | None = None) -> Column:
    """All of language, path and prefix must hold, and one of the kinds."""
    out = F.lit(True)
    if language:
        out = out & (F.col("language") == language)
    if path:
        out = out & (F.col("file_path") == path)
    if prefix:
        p = "/".join(filter(None, re.split(r"[\\/]", prefix.lower())))
        out = out & (F.array_contains("path_prefixes", p) | F.lower("file_path").contains(p))
    if kinds:
        out = out & F.col("symbol_kind").isin(*kinds)
    return out


@dataclass
class Part:
    kind: str  # lex, vec or hyde
    text: str


def structured(text: str) -> list[Part]:
    """Lines `lex:`, `vec:` and `hyde:`; a line without prefix is vec."""
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        head, colon, rest = line.partition(":")
        kind = head.strip().lower()
        out.append(Part(kind, rest.strip()) if colon and kind in ("lex", "vec", "hyde") and rest.strip() else Part("vec", line))
    return out


def structured_weights(parts: list[Part]) -> dict[int, float]:
    """The first list counts twice."""
    return {i: 2.0 if i == 0 else 1.0 for i in range(len(parts))}


@dataclass(frozen=True)
class Bias:
    """A preset: vector space, weights of both spaces and of keywords, whether results are reranked, how many more are
    returned."""

    mode: str
    weights: tuple[float, float]
    keywords: float
    rerank: bool
    factor: float = 1.0


BIAS = {
    "debug": Bias("hybrid", (0.6, 0.4), 0.4, True, 1.5),
    "discovery": Bias("hybrid", (0.3, 0.7), 0.0, True, 2.0),
    "implementation": Bias("hybrid", (0.7, 0.3), 0.3, False),
    "planning": Bias("description", (0.0, 1.0), 0.0, True, 2.0),
    "precise": Bias("code", (1.0, 0.0), 0.5, False),
}


def hybrid(first: DataFrame, second: DataFrame, limit: int, *, weights: tuple[float, float] = (0.5, 0.5), key: str = "key") -> DataFrame:
    """Fuses two ranked frames (query_id, key, score, rank) and ranks the sum."""
    both = first.withColumn("list", F.lit(0)).unionByName(second.withColumn("list", F.lit(1)))
    return ranked(rrf(both, dict(enumerate(weights)), key=key), key=key).where(F.col("rank") <= limit)
