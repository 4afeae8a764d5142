"""How queries and their SQL are registered, and the tables that they share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import tokens as T
from textquarry.operators import text_index as I
from textquarry.sources.snapshots import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, folder) under its own name, with the SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


PATH_SQL = "concat(source, '/', lang, '/doc_', doc_id, '.txt')"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: doc, path, file_path, language, text, source."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), "doc_id", F.lit(".txt"))
    return table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), path.alias("path"), path.alias("file_path"), F.col("lang").alias("language"), "text", "source", "n_chars")


_indexes: dict[tuple, I.TextIndex] = {}


def text_index(spark: SparkSession, folder: str) -> I.TextIndex:
    """The index over all documents of a folder: built and written once a session and state of the table, then read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/documents.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    state = (spark.sparkContext.applicationId, str(path), fs.getContentSummary(path).getLength(), fs.getFileStatus(path).getModificationTime())
    if state not in _indexes:
        at = f"{scratch(spark)}/index-{uuid.uuid4().hex}"
        I.build(files(spark, folder), whole=True).write(at)
        _indexes[state] = I.read(spark, at)
    return _indexes[state]


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def split_sql(p: str) -> str:
    """Word parts separated by a space: each kind of boundary twice, as matches overlap."""
    for pattern in (r"(\p{Ll})(\p{Lu})", r"([0-9])(\p{L})", r"(\p{L})([0-9])", r"(\p{Lu})(\p{Lu}\p{Ll})"):
        for _ in range(2):
            p = f"regexp_replace({p}, '{pattern}', '\\1 \\2', 'g')"
    return p


def tokens_sql(key: str, source: str, text: str = "text", name: str = "toks") -> str:
    """CTEs that end in `name` (key, t): the search tokens of a table, one row each."""
    kept = _quoted(T.PRESERVED)
    return rf"""{name}_w AS (SELECT {key}, unnest(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+')) AS w FROM {source}),
{name}_p AS (SELECT {key}, w, lower(w) IN ({kept}) AS whole, unnest(CASE WHEN lower(w) IN ({kept}) THEN [w] ELSE string_split(w, '_') END) AS p FROM {name}_w),
{name}_l AS (SELECT {key}, whole, CASE WHEN whole THEN [lower(w)] WHEN length(p) <= 2 THEN [p] ELSE list_transform(string_split({split_sql('p')}, ' '), lambda x: lower(x)) END AS ps FROM {name}_p WHERE p <> ''),
{name}_u AS (SELECT {key}, whole, unnest(ps) AS t FROM {name}_l),
{name} AS (SELECT {key}, t FROM {name}_u WHERE whole OR (strlen(t) >= 2 AND t NOT IN ({_quoted(T.PROSE_STOPS | T.CODE_STOPS)})))"""
