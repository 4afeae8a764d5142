"""Queries over chunks and their state: deduplication, quality, caps, differences, change feeds, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.functions import paths as P
from textquarry.functions import tokens as T
from textquarry.operators import hygiene as H
from textquarry.operators import incremental as N
from textquarry.operators import packing as K
from textquarry.operators import protocol
from textquarry.operators import symbols as Y
from textquarry.plans.registry import files, query, table
from textquarry.sources.snapshots import scratch
from textquarry.streaming import feed


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as chunks of one file a source."""
    d = table(spark, folder, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("source"), F.col("lang").alias("symbol_name"), F.lit("file").alias("symbol_kind"), F.col("source").alias("file_path"))


HASH = "sha256(concat_ws(chr(10) || chr(0), text, lang, 'file', '', '', ''))"


@query(f"SELECT {HASH} AS dedup_hash, count(*) AS n, min(doc_id) AS keep_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dedup_groups(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks(spark, folder)
    return c.select(H.dedup_hash(c).alias("dedup_hash"), "chunk_id").groupBy("dedup_hash").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("keep_id")).where("n > 1")


@query(f"SELECT doc_id AS chunk_id, count(*) OVER (PARTITION BY {HASH}) AS group_size FROM documents QUALIFY row_number() OVER (PARTITION BY {HASH} ORDER BY doc_id) = 1")
def dedup_representative(spark: SparkSession, folder: str) -> DataFrame:
    return H.dedup(chunks(spark, folder)).where("is_representative").select("chunk_id", "group_size")


@query(f"SELECT count(*) AS total_chunks, count(DISTINCT {HASH}) AS unique_count, count(*) - count(DISTINCT {HASH}) AS duplicate_count FROM documents")
def dedup_stats(spark: SparkSession, folder: str) -> DataFrame:
    return H.dedup_stats(chunks(spark, folder))


@query(f"SELECT doc_id AS chunk_id, min(doc_id) OVER (PARTITION BY {HASH}) AS from_id FROM documents")
def dedup_expand(spark: SparkSession, folder: str) -> DataFrame:
    """What was made for representatives, given to all members."""
    c = chunks(spark, folder)
    made = c.select(H.dedup_hash(c).alias("dedup_hash"), "chunk_id").groupBy("dedup_hash").agg(F.min("chunk_id").alias("from_id"))
    return H.dedup_expand(c, made).select("chunk_id", "from_id")


STATS = r"""s AS (SELECT doc_id, source, text, length(text) AS n, strlen(text) AS b,
  CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\n$', ''), chr(10))) END AS lines,
  list_max(list_transform(string_split(regexp_replace(text, '\n$', ''), chr(10)), lambda x: length(x))) AS longest,
  list_sum(list_transform(string_split(regexp_replace(text, '\n$', ''), chr(10)), lambda x: length(x))) AS total,
  length(text) - length(regexp_replace(text, '\s', '', 'g')) AS spaces,
  length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS letters,
  length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) AS signs FROM documents),
r AS (SELECT *, total / greatest(lines, 1) AS mean,
  least(b / 500.0, 12.0) + least(greatest(lines, 1) / 20.0, 6.0) + letters / greatest(n, 1) * 6.0 + (1.0 - least(signs / greatest(n, 1), 1.0)) * 2.5 AS quality FROM s),
v AS (SELECT *, n > 0 AND (longest >= 1200 OR (lines <= 6 AND mean >= 220) OR (lines <= 3 AND spaces / greatest(n, 1) < 0.04 AND mean > 120)) AS mini FROM r),
j AS (SELECT *, CASE WHEN b < 120 THEN 'small' WHEN mini THEN 'minified' ELSE 'kept' END AS first FROM v),
w AS (SELECT *, CASE WHEN first = 'kept' AND row_number() OVER (PARTITION BY source, first ORDER BY round(quality, 9) DESC, doc_id) > {cap} THEN 'capped' ELSE first END AS verdict FROM j)"""


@query(f"WITH {STATS.replace('{cap}', '20')} SELECT doc_id AS chunk_id, round(quality, 6) AS quality FROM r")
def chunk_quality(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks(spark, folder)
    return c.select("chunk_id", F.round(H.quality(c), 6).alias("quality"))


@query(f"WITH {STATS.replace('{cap}', '20')} SELECT doc_id AS chunk_id, coalesce(mini, false) AS minified FROM v")
def minified_flags(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", F.coalesce(H.minified(F.col("source")), F.lit(False)).alias("minified"))


@query(f"WITH {STATS.replace('{cap}', '20')} SELECT doc_id AS chunk_id, source AS file_path, verdict FROM w")
def per_source_cap(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every chunk when a file may have twenty."""
    return H.judged(chunks(spark, folder), per_file=20).select("chunk_id", "file_path", "verdict")


@query(f"""WITH {STATS.replace('{cap}', '20')} SELECT count(*) AS input_chunks, count(*) FILTER (WHERE verdict = 'kept') AS kept_chunks, count(*) FILTER (WHERE verdict = 'small') AS skipped_small,
count(*) FILTER (WHERE verdict = 'minified') AS skipped_minified, count(*) FILTER (WHERE verdict = 'capped') AS skipped_per_file_cap, count(DISTINCT CASE WHEN verdict = 'capped' THEN source END) AS files_capped FROM w""")
def filter_stats(spark: SparkSession, folder: str) -> DataFrame:
    return H.filter_stats(chunks(spark, folder), per_file=20)


@query("SELECT doc_id AS chunk_id, length(text) AS chars FROM documents ORDER BY length(text) DESC, doc_id LIMIT 500")
def global_cap(spark: SparkSession, folder: str) -> DataFrame:
    """The five hundred longest chunks."""
    return H.global_cap(chunks(spark, folder), 500).select("chunk_id", F.length("source").cast("long").alias("chars"))


@query("SELECT doc_id, sha256(concat_ws('::', source, lang, 'file')) AS chunk_id FROM documents")
def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks(spark, folder)
    return c.select(F.col("chunk_id").alias("doc_id"), H.chunk_id(c).alias("id")).withColumnRenamed("id", "chunk_id")


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def labels_semi(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "source", "lang").join(table(spark, folder, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def labels_anti(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "source", "lang").join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""WITH st AS (SELECT min(doc_id) AS doc_id, n_chars FROM documents GROUP BY text, n_chars)
SELECT d.doc_id FROM documents d ANTI JOIN st ON d.doc_id = st.doc_id AND d.n_chars IS NOT DISTINCT FROM st.n_chars""")
def file_state_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that aren't in a state of first copies, by key and size."""
    d = table(spark, folder, "documents")
    state = d.groupBy("text", "n_chars").agg(F.min("doc_id").alias("file_path")).select("file_path", "n_chars")
    return N.changed_files(d.select(F.col("doc_id").alias("file_path"), "n_chars"), state, by=("n_chars",)).select(F.col("file_path").alias("doc_id"))


@query("""SELECT coalesce(c_custkey, s_suppkey) AS key, CASE WHEN c_custkey IS NULL THEN 'added' WHEN s_suppkey IS NULL THEN 'deleted' WHEN c_nationkey IS NOT DISTINCT FROM s_nationkey THEN 'unchanged' ELSE 'modified' END AS status
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""")
def chunk_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of one table against those of another: added, deleted, modified, unchanged."""
    old = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("h"))
    new = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("h"))
    return N.diff(old, new, keys=("key",), content="h")


SESSIONS = """WITH o AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 86400000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)"""


@query(SESSIONS + " SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS \"end\", count(*) AS events, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM s GROUP BY user_id, k")
def debounce_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of each user without a day's quiet between them."""
    found = feed.debounced(table(spark, folder, "events"), "1 day", path="event_type", keys=("user_id",))
    return found.select("user_id", "start", "end", "events", F.array_join("paths", ",").alias("paths"))


@query("SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    return feed.latest(table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type", "value"), "user_id", "ts", "event_id")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", count(*) AS events FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events a day and type (an extension: the model has no event time)."""
    return feed.windowed(table(spark, folder, "events"), "1 day", keys=("event_type",)).select("event_type", "start", "end", "events")


@query()
def stream_debounce(spark: SparkSession, folder: str) -> DataFrame:
    """The debouncing job as a stream over the events, with what is closed when the stream has read all."""
    at = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, folder, "events").schema
    stream = feed.debounced(spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")), "1 day", path="event_type", keys=("user_id",))
    running = stream.select("user_id", "start", "end", "events", F.array_join("paths", ",").alias("paths")).writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema("user_id long, start timestamp, end timestamp, events long, paths string").parquet(f"{at}/out")


COST = "list_sum(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]'), lambda w: ceil(length(w) / 6.0)::INTEGER))"


@query(f"WITH c AS (SELECT conv_id, turn, coalesce({COST}, 0)::BIGINT AS tokens FROM conversations), u AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM c) SELECT * FROM u WHERE used <= 400")
def pack_prefix_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The first turns of each conversation that fit a budget."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", K.tokens_of(F.col("text")).cast("long").alias("tokens"), (-F.col("turn")).alias("score"))
    return K.pack_prefix(turns, 400, by="conv_id", key="turn").select("conv_id", "turn", "tokens", "used")


@query()
def pack_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """Turns packed into a budget, the longest first, cut where they don't fit."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("score"), F.col("role").alias("meta"), F.col("text").alias("source"))
    return K.pack_greedy(turns, 300, least=16, by="conv_id", key="turn").select("conv_id", "turn", "tokens", "truncated")


@query("""SELECT conv_id, turn, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM conversations""")
def context_window(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", protocol.context(turns, 2, key="conv_id", line="text", at="turn").alias("context"))


@query("""WITH l AS (SELECT page_id, lower(unnest(string_split(html, chr(10)))) AS x FROM pages)
SELECT page_id, count(*) AS marked FROM l WHERE contains(x, 'http://') OR contains(x, 'https://') OR contains(x, 'api/') OR contains(x, 'endpoint') OR contains(x, 'graphql') OR contains(x, 'operationname') OR contains(x, 'operation_name')
 OR contains(x, 'queryid') OR contains(x, '"method"') OR contains(x, '#[serde(rename') OR contains(x, 'post(') OR contains(x, 'get(') OR contains(x, 'put(') OR contains(x, 'delete(') OR contains(x, 'patch(') GROUP BY page_id""")
def protocol_markers(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines of each page hold a marker of a contract."""
    lines = table(spark, folder, "pages").select("page_id", F.explode(F.split("html", "\n")).alias("x"))
    return lines.where(protocol.has_marker(F.col("x"))).groupBy("page_id").agg(F.count(F.lit(1)).alias("marked"))


@query()
def protocol_search(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts in the pages."""
    pages = table(spark, folder, "pages").select(F.col("url").alias("file_path"), F.col("html").alias("text"))
    return protocol.contracts(pages, limit=None).select("file_path", "operation", "transport", "endpoint", "score", "confidence")


@query()
def html_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Titles, headings and named elements of pages."""
    pages = table(spark, folder, "pages").select(F.col("url").alias("file_path"), F.lit("html").alias("language"), F.col("html").alias("text"))
    return Y.extract(pages).select("file_path", "name", "kind", "line_start", "line_end", "role")


@query()
def symbol_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked lookup among the symbols of pages."""
    pages = table(spark, folder, "pages").select(F.col("url").alias("file_path"), F.lit("html").alias("language"), F.col("html").alias("text"))
    return Y.lookup(Y.extract(pages), "erreth heer").select("file_path", "name", "kind", "score")


@query(r"""WITH n AS (SELECT p_partkey, replace(lower(p_name), ' ', '_') AS name FROM part)
SELECT p_partkey, CASE WHEN name IN ('specs', 'spec', 'test', 'tests') OR regexp_matches(name, '^(spec|test)[_.]|_(specs|tests|spec|test)$') THEN 'test'
WHEN regexp_matches(name, '^(config|setup|settings|init_config|load_config|configure)_?|_(config|settings|options|setup)$') THEN 'configuration'
WHEN name IN ('main', 'run', 'serve', 'start', 'execute', 'cli', 'app', 'handler', 'entry', 'bootstrap') THEN 'entrypoint'
WHEN regexp_matches(name, '^(orchestrate|process|handle|dispatch|coordinate|manage|execute|pipeline|workflow|run_all)(_|$)') THEN 'orchestration'
WHEN regexp_matches(name, '_(aux|impl|internal|util|helper)$') THEN 'utility' ELSE 'logic' END AS role FROM n""")
def role_classify(spark: SparkSession, folder: str) -> DataFrame:
    """Roles by name of functions called like the parts."""
    s = table(spark, folder, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.lit("function").alias("kind"), F.concat("p_brand", F.lit(".py")).alias("file_path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("visibility"))
    return s.select("p_partkey", Y.role().alias("role"))


@query("""WITH p AS (SELECT [source, lang] AS parts FROM documents), a AS (SELECT parts, unnest([0, 1, 2]) AS depth FROM p)
SELECT array_to_string(parts[1:depth], '/') AS dir, depth, count(*) AS file_count FROM a GROUP BY ALL""")
def skeleton_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Files below every folder."""
    return Y.skeleton(files(spark, folder)).select("dir", "depth", "file_count")


@query("""WITH p AS (SELECT [lower(source), lower(lang), concat('doc_', doc_id, '.txt')] AS parts FROM documents), a AS (SELECT parts, unnest([1, 2, 3]) AS k FROM p)
SELECT array_to_string(parts[1:k], '/') AS prefix, count(*) AS n FROM a GROUP BY ALL""")
def path_prefix_counts(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).select(F.explode(T.path_prefixes("path")).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


@query(SESSIONS + """, sess AS (SELECT user_id, k, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM s GROUP BY ALL),
d AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS day FROM events),
r AS (SELECT user_id, a, b, concat('session-', a) AS id FROM sess UNION ALL SELECT user_id, epoch_us(day), epoch_us(day) + 86399999999, concat('day-', epoch_us(day)) FROM d)
SELECT event_id, id AS symbol_id FROM events e JOIN r ON e.user_id = r.user_id AND epoch_us(e.ts) BETWEEN a AND b QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY b - a, a DESC, id) = 1""")
def enclosing_range_join(spark: SparkSession, folder: str) -> DataFrame:
    """For every event the smallest range that holds it, of its user's sessions and days."""
    ev = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "ts", F.unix_micros("ts").alias("at"))
    order = Window.partitionBy("user_id").orderBy("ts")
    fresh = F.when(F.col("at") - F.lag("at").over(order) <= 86_400_000_000, 0).otherwise(1)
    numbered = ev.withColumn("f", fresh).withColumn("k", F.sum("f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sessions = numbered.groupBy("user_id", "k").agg(F.min("at").alias("byte_start"), F.max("at").alias("byte_end")).select("user_id", F.concat(F.lit("session-"), "byte_start").alias("symbol_id"), "byte_start", "byte_end")
    day = F.unix_micros(F.date_trunc("day", "ts"))
    days = ev.select("user_id", day.alias("byte_start")).distinct().select("user_id", F.concat(F.lit("day-"), "byte_start").alias("symbol_id"), "byte_start", (F.col("byte_start") + 86_399_999_999).alias("byte_end"))
    return Y.enclosing(ev, sessions.unionByName(days), file="user_id", key="event_id").select("event_id", "symbol_id")


@query()
def smart_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All documents cut at good places."""
    return K.chunk_files(files(spark, folder)).select("file_path", "no", "start", "end", "line_start", "line_end")


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\n+$', '') AS compressed FROM documents""")
def compress_light(spark: SparkSession, folder: str) -> DataFrame:
    return K.compressed(files(spark, folder), "light").select(F.col("doc").alias("doc_id"), "compressed")


@query()
def artifact_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Names in the pages, rarest first."""
    return K.signals(table(spark, folder, "pages").select(F.col("url").alias("file_path"), F.col("html").alias("text")))


@query("""SELECT lang AS language, length(text) >= 0 AS is_text, count(*) AS n, sum((strlen(text) <= 2097152)::INTEGER)::BIGINT AS small_enough FROM documents GROUP BY ALL""")
def size_cap(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).groupBy("language", (F.length("text") >= 0).alias("is_text")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.octet_length("text") <= 2 << 20).cast("int")).alias("small_enough"))


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents")
def content_sha256(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).select(F.col("doc").alias("doc_id"), F.sha2("text", 256).alias("file_hash"))


@query("SELECT page_id, CASE WHEN contains(split_part(url, '/', -1), '.') THEN CASE lower(split_part(url, '.', -1)) WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'php' THEN 'php' WHEN 'js' THEN 'javascript' END END AS language FROM pages")
def detect_language(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", P.detect_language("url").alias("language"))
