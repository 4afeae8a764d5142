"""The inverted index as tables, and BM25 over it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import tokens as T

K1, B, PATH_WEIGHT, BASENAME_COPIES, MAX_BYTES = 1.5, 0.5, 0.5, 4, 2 << 20
#: About so many bytes of text are tokenised in one task, whatever shuffle partitions are set or joined at run time.
PART_BYTES = 8 << 20
#: Scores of a table of queries in one task; rows (query, term) of such a table that are broadcast.
PAIRS, QUERY_TERMS = 500_000, 200_000


@dataclass
class TextIndex:
    """docs (doc, path, language, doc_len, path_len), postings and path_postings (term, doc, tf)."""

    docs: DataFrame
    postings: DataFrame
    path_postings: DataFrame

    def write(self, folder: str) -> None:
        """Parquet; postings are sorted by term within files, so a query's terms skip most row groups. Document lengths are
        added up from the postings written, so that texts are read and tokenised once."""
        for name in ("postings", "path_postings"):
            getattr(self, name).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/{name}")
        stored = [self.docs.sparkSession.read.parquet(f"{folder}/{n}") for n in ("postings", "path_postings")]
        measured(self.docs.select("doc", "path", "language"), *stored).write.mode("overwrite").parquet(f"{folder}/docs")


def read(spark, folder: str) -> TextIndex:
    return TextIndex(*[spark.read.parquet(f"{folder}/{n}") for n in ("docs", "postings", "path_postings")])


def parts(df: DataFrame, size: int, most: int) -> int:
    """Into how many partitions to put `size`: no more than about `most` in one, and all cores busy from an eighth of it on."""
    return max(1, -(-size // most), min(df.sparkSession.sparkContext.defaultParallelism, size * 8 // most))


def term_counts(rows: DataFrame, key: str, text: Column, size: int) -> DataFrame:
    """(term, doc, tf): each document's words are counted, then each different one is tokenised once. size: bytes of all texts.

    Rows are brought together by document before words are made of them; counting words and terms then needs no further
    shuffle, and no more than the texts themselves travels. The number of partitions is stated, as a task holds many times
    its bytes of text and adaptive execution would join partitions by those.
    """
    held = rows.select(F.col(key).alias("doc"), text.alias("text")).repartition(parts(rows, size, PART_BYTES), "doc")
    words = held.select("doc", F.explode(T.raw_words("text")).alias("word")).groupBy("doc", "word").agg(F.count(F.lit(1)).alias("n"))
    found = words.select("doc", "n", F.explode(T.word_tokens("word")).alias("term"))
    return found.groupBy("doc", "term").agg(F.sum("n").alias("tf")).select("term", "doc", "tf")


def vocabulary_counts(rows: DataFrame, text: Column) -> DataFrame:
    """(term, n) over all rows: words are counted before they are tokenised, partial counts are shuffled."""
    words = rows.select(F.explode(T.raw_words(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.select("n", F.explode(T.word_tokens("word")).alias("term")).groupBy("term").agg(F.sum("n").alias("n"))


def measured(docs: DataFrame, postings: DataFrame, path_postings: DataFrame) -> DataFrame:
    """docs with doc_len and path_len."""
    size = lambda p, out: p.groupBy("doc").agg(F.sum("tf").alias(out))
    return docs.join(size(postings, "doc_len"), "doc", "left").join(size(path_postings, "path_len"), "doc", "left").na.fill(0, ["doc_len", "path_len"])


def build(files: DataFrame, *, key: str = "doc", path: str = "path", text: str = "text", language: str = "language", whole: bool = False) -> TextIndex:
    """Index of files. Texts over 2 MiB or with a NUL character, and null ones, are left out, unless the whole table is
    asked for; the base name counts four times more. Only bytes are added up yet: write it, and read what was written."""
    ok = files if whole else files.where((F.octet_length(text) <= MAX_BYTES) & ~F.col(text).contains("\x00"))
    name = F.substring_index(F.col(path), "/", -1)
    weighed = F.concat_ws(" ", F.col(path), *[name] * BASENAME_COPIES)
    sizes = ok.agg(F.sum(F.octet_length(text)), F.sum(F.octet_length(weighed))).first()
    postings = term_counts(ok, key, F.col(text), sizes[0] or 0)
    path_postings = term_counts(ok, key, weighed, sizes[1] or 0)
    docs = ok.select(F.col(key).alias("doc"), F.col(path).alias("path"), F.col(language).alias("language"))
    return TextIndex(measured(docs, postings, path_postings), postings, path_postings)


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def tf_norm(tf: Column, size: Column, mean: Column) -> Column:
    return tf * F.lit(K1 + 1.0) / (tf + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * (F.greatest(size, F.lit(1)) / mean)))


def _scores(postings: DataFrame, docs: DataFrame, length: str, queries: DataFrame, terms: Sequence[str] | None, size: tuple[int, bool] | None) -> DataFrame:
    """(query, doc, pos, term, score) of one field. Only postings of query terms are read on; df is counted on those.

    size: into how many partitions by document to put the rows of a table of queries, and whether that table is broadcast.
    Then all scores of a document are in one task, and adding them up needs no shuffle of them.
    """
    few = terms is not None
    hint = F.broadcast if few or size and size[1] else lambda x: x
    hits = postings.where(F.col("term").isin(*terms)) if few else postings.join(hint(queries.select("term").distinct()), "term")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), (F.greatest(F.sum(length), F.lit(1)) / F.count(F.lit(1))).alias("mean"))
    weighed, sizes = hits.join(hint(df), "term"), docs.select("doc", length)
    if size:
        n, small = size
        by_doc = lambda x: x.repartition(n, "doc")
        weighed = by_doc(weighed).join(hint(queries), "term") if small else by_doc(weighed.join(queries, "term"))
        sizes = by_doc(sizes)
    weighed = weighed.join(sizes, "doc").crossJoin(F.broadcast(stats))  # one row
    score = idf(F.col("n"), F.col("df")) * tf_norm(F.col("tf"), F.col(length), F.col("mean"))
    if size:
        return weighed.select("query", "doc", "pos", "term", score.alias("score"))
    return weighed.select("doc", "term", score.alias("score")).join(hint(queries), "term")


def bm25(index: TextIndex, queries: DataFrame, *, paths: bool = True, terms: Sequence[str] | None = None) -> DataFrame:
    """(query, doc, score, matched): content plus half the path score; document counts are of the whole index.

    queries: (query, pos, term). terms: all their terms, if they come from the driver: then only the postings of those are
    read, and the queries are small enough to broadcast. A table of queries is counted: of at most QUERY_TERMS rows it is
    broadcast, else joined by term; documents go to so many tasks that about PAIRS scores are in one, if each query finds
    each document. matched holds a term once for the content and once for the path, by position.
    """
    size = None
    if terms is None:
        rows, asking = queries.agg(F.count(F.lit(1)), F.countDistinct("query")).first()
        size = parts(index.docs, index.docs.count() * max(asking, 1), PAIRS), rows <= QUERY_TERMS
    content = _scores(index.postings, index.docs, "doc_len", queries, terms, size).select("query", "doc", "pos", "term", F.lit(0).alias("part"), "score")
    if paths:
        extra = _scores(index.path_postings, index.docs, "path_len", queries, terms, size).select("query", "doc", "pos", "term", F.lit(1).alias("part"), (F.col("score") * F.lit(PATH_WEIGHT)).alias("score"))
        content = content.unionByName(extra)
    summed = content.groupBy("query", "doc").agg(F.sum("score").alias("score"), F.array_sort(F.collect_list(F.struct("pos", "part", "term"))).alias("m"))
    return summed.select("query", "doc", "score", F.transform("m", lambda x: x["term"]).alias("matched"))


def asked(index: TextIndex, queries: dict[str, str], *, paths: bool = True) -> DataFrame:
    """bm25 of query strings."""
    spark = index.docs.sparkSession
    return bm25(index, query_frame(spark, queries), paths=paths, terms=list(dict.fromkeys(t for q in queries.values() for t in T.query_tokens(q))))


def query_frame(spark, queries: dict[str, str] | Sequence[tuple[str, str]]) -> DataFrame:
    """(query, pos, term) of query strings, tokenised in the driver."""
    rows = [(name, i, t) for name, text in dict(queries).items() for i, t in enumerate(T.query_tokens(text))]
    return spark.createDataFrame(rows, "query string, pos int, term string")
