"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import content_id, fresh, map_arrow, release, small_batches
from textquarry.llm.textvec import blocks, code_points, fold_table

#: Sizes of n-grams, hashed to 2**BITS features; SCALE brings relative frequencies to the order of one.
ORDERS, BITS, SCALE = (2, 3), 16, 64.0
#: Bounds of the training sample, in labelled texts a language and in all (of very many languages each gets fewer, but all
#: are learnt); epochs over it.
SAMPLE_PER_LANGUAGE, SAMPLE, EPOCHS = 1500, 60_000, 3
#: Follow-the-regularised-leader: learning rate, smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.01
#: A document is accepted if its most likely language has at least this calibrated probability.
MIN_PROB = 0.4
FEATURES = 1 << BITS
#: Tasks whose counts are added up together.
MERGED = 256


@cache
def letters() -> np.ndarray:
    """Folded letters and marks; 0 for all else, digits too."""
    table = fold_table().copy()
    for c in np.flatnonzero(table).tolist():
        if unicodedata.category(chr(c))[0] == "N":
            table[c] = 0
    return table


def ngrams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each size the feature that begins at every place (FEATURES where none does), and where each text begins.

    Texts are taken with one separator on either side; n-grams don't reach beyond it, and hold a letter.
    """
    points, at = code_points(["", *texts])
    folded = letters()[points]
    letter, end = folded != 0, np.zeros(points.size, bool)
    end[at[1:] - 1] = True
    out = []
    for n in ORDERS:
        size = points.size - n + 1
        h, some, cross = np.zeros(size, np.uint32), np.zeros(size, bool), np.zeros(size, bool)
        for i in range(n):
            h = (h ^ folded[i : i + size]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            some |= letter[i : i + size]
            if 0 < i < n - 1:
                cross |= end[i : i + size]
        feature = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int32)
        feature[~some | cross] = FEATURES
        out.append(np.concatenate([feature, np.full(n - 1, FEATURES, np.int32)]))
    return out, at[1:-1] - 1


def _spans(begin: np.ndarray, total: int) -> list[tuple[int, int]]:
    return list(zip(begin.tolist(), [*begin[1:].tolist(), total]))


def document_frequency(many: list[str]) -> np.ndarray:
    """Of each feature, how many texts hold it."""
    df, mark = np.zeros(FEATURES + 1, np.int64), np.zeros(FEATURES + 1, bool)
    for a, b in blocks(many):
        grams, begin = ngrams(many[a:b])
        for s, e in _spans(begin + 0, grams[0].size - 1):
            if (e - s) > 1500:
                mark[:] = False
                for g in grams:
                    mark[g[s:e]] = True
                df += mark
            else:
                df[np.unique(np.concatenate([g[s:e] for g in grams]))] += 1
    return df[:FEATURES]


def count_documents(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Document frequencies and the number of texts, over all rows.

    Partial counts are added up by slices of features, first of every MERGED tasks, then of all: no task holds more than
    MERGED or tasks / MERGED partial slices of 32 kB.
    """
    small_batches(docs.sparkSession)
    slices = 16
    width = FEATURES // slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                texts = batch.slice(at, 500).column(0).drop_null().to_pylist()
                df += document_frequency(texts)
                n += len(texts)
        rows = [df[i * width : (i + 1) * width].tobytes() for i in range(slices)] + [np.array([n], np.int64).tobytes()]
        part = TaskContext.get().partitionId() // MERGED
        release()
        yield pa.RecordBatch.from_arrays([pa.array([part] * (slices + 1), pa.int32()), pa.array(range(slices + 1), pa.int32()), pa.array(rows, pa.binary())], ["part", "slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return table.slice(0, 1).set_column(2, "counts", pa.array([total.tobytes()], pa.binary()))

    kind = "part int, slice int, counts binary"
    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, kind).groupBy("part", "slice").applyInArrow(add, kind).groupBy("slice").applyInArrow(add, kind)
    found = {r["slice"]: np.frombuffer(bytes(r["counts"]), np.int64) for r in parts.collect()}
    df = np.concatenate([found.get(i, np.zeros(width, np.int64)) for i in range(slices)])
    return df, int(found[slices][0]) if slices in found else 0


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (FEATURES + 1) x languages: inverse document frequency times weight, last row 0
    bias: np.ndarray
    temperature: float

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Uncalibrated scores, and of each text the number of its n-grams."""
        out, sizes = [], []
        for a, b in blocks(texts):
            grams, begin = ngrams(texts[a:b])
            total, n = np.zeros((b - a, len(self.languages))), np.zeros(b - a)
            for g in grams:
                total += np.add.reduceat(self.table[g], begin, axis=0, dtype=np.float64)
                n += np.add.reduceat(g != FEATURES, begin, dtype=np.int64)
            out.append(total * (SCALE / np.maximum(n, 1))[:, None] + self.bias)
            sizes.append(n)
        return np.concatenate([np.zeros((0, len(self.languages))), *out]), np.concatenate([np.zeros(0), *sizes])

    def predict(self, texts: list[str]) -> tuple[list[str | None], np.ndarray]:
        """The most likely language of each text and its calibrated probability; none, 0 for a text without letters."""
        scores, n = self.scores(texts)
        if not self.languages:
            return [None] * len(texts), np.zeros(len(texts))
        p = softmax(scores / self.temperature)
        best = p.argmax(axis=1)
        named = [self.languages[i] if k else None for i, k in zip(best.tolist(), n.tolist())]
        return named, np.where(n > 0, p[np.arange(len(texts)), best], 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's features and values; the last is the constant."""
    grams, _ = ngrams([text])
    found = np.concatenate(grams)
    features, counts = np.unique(found[found != FEATURES], return_counts=True)
    return np.append(features, FEATURES), np.append(SCALE * idf[features] * counts / max(1, counts.sum()), 1.0)


def train(texts: list[str], labels: list[str], idf: np.ndarray, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal with elastic net on four of five texts; the temperature is fitted on the others."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels], int)
    held = np.arange(len(texts)) % 5 == 4
    data = [vector(t, idf) for t in texts]
    z, n = np.zeros((FEATURES + 1, len(languages))), np.zeros((FEATURES + 1, len(languages)))

    def weights(f: np.ndarray | slice) -> np.ndarray:
        zf = z[f]
        return np.where(np.abs(zf) <= L1, 0.0, -(zf - np.sign(zf) * L1) / ((BETA + np.sqrt(n[f])) / ALPHA + L2))

    for _ in range(epochs):
        for i in np.flatnonzero(~held).tolist():
            f, x = data[i]
            w = weights(f)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            new = n[f] + g * g
            z[f] += g - (np.sqrt(new) - np.sqrt(n[f])) / ALPHA * w
            n[f] = new
    w = weights(slice(None))
    table = (w * np.append(idf, 0.0)[:, None]).astype(np.float32)
    model = Model(languages, table, w[FEATURES], 1.0)
    if held.any():
        scores, _ = model.scores([t for t, h in zip(texts, held) if h])
        truth = y[held]
        model.temperature = fit_temperature(scores, truth)
    return model


def fit_temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature in [1/20, 20] with the least log loss, by golden-section search over its logarithm."""

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(truth.size), truth], 1e-300)).mean())

    lo, hi, ratio = -np.log(20), np.log(20), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        if loss(a) <= loss(b):
            hi = b
        else:
            lo = a
    return float(np.exp((lo + hi) / 2))


def sample(docs: DataFrame, *, text: str, label: str, per_language: int, most: int = SAMPLE) -> tuple[list, list]:
    """At most per_language different labelled texts of each language, and about `most` of all.

    The hashes of label and text fall into per_language slots a language; of each slot the least one is taken. So the
    number is bounded whatever repeats, keys play no part, and every language with a text has one. Slots are found by
    partial aggregates of hashes; only the texts chosen come to the driver.
    """
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    rows = rows.withColumn("draw", F.xxhash64("label", content_id("text")))
    languages = rows.select("label").distinct().count()
    slots = max(1, min(per_language, most // max(1, languages)))
    chosen = rows.groupBy("label", F.pmod("draw", F.lit(slots)).alias("slot")).agg(F.min("draw").alias("least")).select(F.col("label").alias("of"), "least")
    held = rows.join(F.broadcast(chosen), (F.col("label") == F.col("of")) & (F.col("draw") == F.col("least")))
    drawn = held.groupBy("label", "draw").agg(F.min("text").alias("text")).toArrow().to_pylist()
    drawn.sort(key=lambda r: (r["draw"], r["label"]))
    return [r["text"] for r in drawn], [r["label"] for r in drawn]


def fit(docs: DataFrame, *, text: str = "text", label: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Document frequencies come from all texts; the weights from a bounded sample of labelled rows, in the driver."""
    df, n = count_documents(docs, text)
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0.0)
    texts, labels = sample(docs, text=text, label=label, per_language=per_language)
    return train(texts, labels, idf)


def classify(docs: DataFrame, model: Model, *, text: str = "text", names: tuple[str, str] = ("lang_pred", "prob")) -> DataFrame:
    """All rows and columns (columns named like `names` are replaced) with predicted language and probability."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.table, model.bias, model.temperature))
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    (copy,) = fresh([*docs.columns, *names], "text_copy")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = Model(*shared.value)
        named, p = m.predict([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(named, pa.string()), pa.array(p)], [*kept, *names])

    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias(copy))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], f"`{names[0]}` string", f"`{names[1]}` double"])
    return map_arrow(rows, run, schema, text=copy)


def identify(docs: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang", min_prob: float = MIN_PROB) -> DataFrame:
    """Every row: doc_id, lang_pred, prob, accepted.

    The model is trained on the label column of these rows, on at most SAMPLE_PER_LANGUAGE texts of each label and about
    SAMPLE in all; null labels and texts are left out of training, keys play no part. Every label is learnt; the model has
    FEATURES numbers a label. A null
    text, or one without letters, has no language and probability 0, and isn't accepted. Repeated rows get equal
    results; ties between languages go to the first by name. Without any label no text has a language. Whole texts
    count. Other columns aren't read. An empty table stays empty.
    """
    model = fit(docs, text=text, label=label)
    done = classify(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), model)
    return done.select("doc_id", "lang_pred", "prob", (F.col("prob") >= min_prob).alias("accepted"))


def keep_identified(docs: DataFrame, *, text: str = "text", label: str = "lang", min_prob: float = MIN_PROB) -> DataFrame:
    """The rows whose language can be told (accepted, as in identify), with their columns as they are."""
    model = fit(docs, text=text, label=label)
    names = tuple(fresh(docs.columns, "lang_pred", "lang_prob"))
    return classify(docs, model, text=text, names=names).where(F.col(names[1]) >= min_prob).select(*[F.col(f"`{c}`") for c in docs.columns])
