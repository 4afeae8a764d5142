"""Repeated runs of lines, cut where the content says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import Tables, small

#: A chunk ends after a line where the rolling hash of it and the two before it is a multiple of EVERY.
EVERY, B1, B2 = 4, 31, 961


def chunks(text: str | Column, every: int = EVERY) -> Column:
    """Array of (no, lines, text): consecutive lines, cut where a rolling hash over three line hashes is 0 mod `every`.

    A cut depends on three lines only, so inserted lines shift no cuts further on.
    """
    col = F.col(text) if isinstance(text, str) else text
    lines = F.split(col, "\n")
    packed = F.struct(lines.alias("l"), F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")).alias("h"))

    def before(h: Column, i: Column, k: int) -> Column:
        return F.when(i >= k, F.element_at(h, i - k + 1)).otherwise(F.lit(0))

    def ended(p: Column) -> Column:
        n = F.size(p["l"])
        rolling = lambda i: (before(p["h"], i, 0) + F.lit(B1) * before(p["h"], i, 1) + F.lit(B2) * before(p["h"], i, 2)) % F.lit(every)
        ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | (rolling(i) == 0))
        return F.struct(p["l"].alias("l"), ends.alias("e"))

    def cut(p: Column) -> Column:
        begin = lambda j: F.when(j > 0, F.element_at(p["e"], j) + 1).otherwise(F.lit(0))
        return F.transform(
            p["e"],
            lambda e, j: F.struct(j.alias("no"), (e - begin(j) + 1).alias("lines"), F.array_join(F.slice(p["l"], begin(j) + 1, e - begin(j) + 1), "\n").alias("text")),
        )

    # transform over one element binds what is used more than once
    once = F.transform(F.transform(F.array(packed), ended), cut)
    return F.when(col.isNotNull(), F.element_at(once, 1))


def dedupe(docs: DataFrame, *, key: str = "doc_id", text: str = "text", every: int = EVERY) -> DataFrame:
    """All rows: doc_id, text without chunks of two or more lines that occur earlier, removed_chunks, removed_lines.

    "Earlier" is by doc_id (null last), then by the text's MD5, then by place. Chunks of one line, or without any
    visible character, stay. Hash counts route chunks; their bytes decide. Rows with equal doc_id and text are one
    document here and are treated alike. A null text stays null, an empty one empty; of very long ones every line
    counts. Columns other than key and text aren't read and don't come along. An empty table stays empty.

    Moved: a hash a chunk with partial counts; of repeated chunks the bytes once a task; and for the rewrite either
    nothing (the list of removals is small enough to broadcast, as counted) or the texts once.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "lines")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.md5(F.col(text)).alias("cid"))
    found = rows.select("doc_id", "cid", F.explode(chunks("text", every)).alias("c")).where((F.col("c.lines") >= 2) & (F.length(F.trim(F.translate("c.text", "\n\t\r", ""))) > 0))
    found = found.select("doc_id", "cid", F.col("c.no").alias("no"), F.col("c.lines").alias("lines"), F.col("c.text").alias("chunk"), F.xxhash64("c.text").alias("h"))
    repeated = tables.write(found.groupBy("h").count().where("count > 1").select("h"))
    again = tables.write(found.join(small(repeated, 16), "h", "left_semi"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "cid", "no")
    # the least and the greatest of a hash's chunks are the same bytes unless hashes collide; partial results keep a
    # chunk that stands in very many documents from gathering in one task
    heads = tables.write(again.groupBy("h").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"), F.min(place).alias("head")).select("h", "head", (F.col("least") != F.col("most")).alias("mixed")))
    placed = again.withColumn("place", place).join(small(heads, 100), "h")
    order = Window.partitionBy("h", "chunk").orderBy("place")
    plain = placed.where("NOT mixed AND place != head").select("doc_id", "cid", "no", "lines")
    mixed = placed.where("mixed").withColumn("rank", F.dense_rank().over(order)).where("rank > 1").select("doc_id", "cid", "no", "lines")
    later = plain.unionByName(mixed)
    gone = tables.write(later.groupBy(F.col("doc_id").alias("d"), F.col("cid").alias("c")).agg(F.sort_array(F.collect_set("no")).alias("nos"), F.sum("lines").alias("total"), F.count(F.lit(1)).alias("n"), F.countDistinct("no").alias("k")))
    gone = gone.select("d", "c", "nos", (F.col("total") * F.col("k") / F.col("n")).cast("int").alias("removed_lines"))
    joined = rows.join(small(gone, 88), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("cid") == F.col("c")), "left")
    left = F.filter(chunks("text", every), lambda c: ~F.array_contains(F.col("nos"), c["no"]))
    cleaned = F.when(F.col("nos").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda c: c["text"]), "\n"))
    count = F.coalesce(F.size("nos"), F.lit(0))
    return joined.select("doc_id", cleaned.alias("text"), F.when(F.col("nos").isNull(), 0).otherwise(count).alias("removed_chunks"), F.coalesce("removed_lines", F.lit(0)).alias("removed_lines"))


def dedupe_sql(every: int = EVERY) -> str:
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (SELECT r, doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs WHERE text IS NOT NULL),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM lines),
ended AS (SELECT *, (h + {B1} * lag(h, 1, 0) OVER w + {B2} * lag(h, 2, 0) OVER w) % {every} = 0 AS cut FROM hashed WINDOW w AS (PARTITION BY r ORDER BY i)),
numbered AS (SELECT *, coalesce(sum(cut::INTEGER) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM ended),
chunks AS (SELECT r, doc_id, any_value(text) AS text, no, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM numbered GROUP BY r, doc_id, no),
placed AS (SELECT *, n >= 2 AND length(trim(translate(chunk, chr(10) || chr(9) || chr(13), ''))) > 0 AS counts FROM chunks),
ranked AS (SELECT *, CASE WHEN counts THEN dense_rank() OVER (PARTITION BY counts, chunk ORDER BY doc_id NULLS LAST, md5(text), no) ELSE 1 END AS k FROM placed)
SELECT d.doc_id, CASE WHEN count(*) FILTER (WHERE k > 1) = 0 THEN any_value(d.text) ELSE coalesce(string_agg(chunk, chr(10) ORDER BY no) FILTER (WHERE k = 1), '') END AS text,
  (count(*) FILTER (WHERE k > 1))::INTEGER AS removed_chunks, coalesce(sum(n) FILTER (WHERE k > 1), 0)::INTEGER AS removed_lines
FROM docs d LEFT JOIN ranked c ON d.r = c.r GROUP BY d.r, d.doc_id"""
