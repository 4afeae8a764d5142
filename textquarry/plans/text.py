"""Queries over texts: tokens, BM25, boolean and literal search, snippets, boosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.functions import paths as P
from textquarry.functions import query as Q
from textquarry.functions import tokens as T
from textquarry.operators import compose as C
from textquarry.operators import text_index as I
from textquarry.operators import text_search as S
from textquarry.plans.registry import PATH_SQL, files, query, table, text_index, tokens_sql

TOKENS = tokens_sql("doc_id", "documents")
SCORED = f"""{TOKENS},
post AS (SELECT t AS term, doc_id, count(*) AS tf FROM toks GROUP BY ALL),
lens AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS len FROM documents d LEFT JOIN post p ON d.doc_id = p.doc_id GROUP BY ALL),
stat AS (SELECT count(*) AS n, greatest(sum(len), 1) / count(*) AS mean FROM lens),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
ONE = "ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.5 + 0.5 * (greatest(len, 1) / mean))))"


@query(f"WITH {TOKENS} SELECT t AS term, count(*) AS n FROM toks GROUP BY t")
def tokenize_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each search token occurs."""
    return I.vocabulary_counts(files(spark, folder), F.col("text")).select("term", "n")


@query(f"WITH {TOKENS} SELECT t AS term, count(DISTINCT doc_id) AS df FROM toks GROUP BY t")
def term_df(spark: SparkSession, folder: str) -> DataFrame:
    """In how many documents each search token occurs: the length of its list in the index."""
    return text_index(spark, folder).postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(f"WITH {TOKENS} SELECT d.doc_id, count(t) AS doc_len, count(DISTINCT t) AS terms FROM documents d LEFT JOIN toks USING (doc_id) GROUP BY d.doc_id")
def doc_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and different tokens of each document, from the index."""
    index = text_index(spark, folder)
    terms = index.postings.groupBy("doc").agg(F.count(F.lit(1)).alias("terms"))
    return index.docs.join(terms, "doc", "left").select(F.col("doc").alias("doc_id"), "doc_len", F.coalesce("terms", F.lit(0).cast("long")).alias("terms"))


def benchmark_terms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query"), F.posexplode(T.unique_tokens("text")).alias("pos", "term"))


def benchmark_hits(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """The k best documents of each benchmark item: query, doc, score (rounded), rank; ties by doc."""
    found = I.bm25(text_index(spark, folder), benchmark_terms(spark, folder), paths=False).withColumn("score", F.round("score", 6))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


BATCH = f"""WITH {SCORED}, {tokens_sql("item_id", "benchmark", name="qt")},
q AS (SELECT DISTINCT item_id, t AS term FROM qt),
scored AS (SELECT item_id, doc_id, round(sum({ONE}), 6) AS score FROM q JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), stat GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= TOPK)"""


@query(BATCH.replace("TOPK", "5") + " SELECT item_id, doc_id, score, rank::INTEGER AS rank FROM best")
def bm25_batch_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """The five best documents of each benchmark item."""
    return benchmark_hits(spark, folder, 5).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", "rank")


@query(BATCH.replace("TOPK", "10") + """, expected AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
per AS (SELECT e.item_id, min(rank) AS first FROM expected e LEFT JOIN best USING (item_id, doc_id) GROUP BY e.item_id)
SELECT count(*) AS queries, avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END) AS hit_at_1, avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END) AS hit_at_3, round(avg(coalesce(1.0 / first, 0.0)), 9) AS mrr FROM per""")
def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Hit@1, Hit@3 and MRR of the ten best documents, over items that some document holds whole."""
    hits = benchmark_hits(spark, folder, 10).select(F.col("query").alias("query_id"), F.concat(F.lit("/doc_"), "doc", F.lit(".txt")).alias("file_path"), "rank")
    held = benchmark_containment(spark, folder).select(F.col("item_id").alias("query_id"), F.concat(F.lit("/doc_"), "doc_id", F.lit(".txt")).alias("fragment"))
    return C.retrieval_metrics(hits, held).select("queries", "hit_at_1", "hit_at_3", F.round("mrr", 9).alias("mrr"))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def benchmark_containment(spark: SparkSession, folder: str) -> DataFrame:
    """Items that stand whole in a document."""
    items = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("item"))
    return files(spark, folder).select(F.col("doc").alias("doc_id"), "text").join(items, F.col("text").contains(F.col("item"))).select("item_id", "doc_id")


PATHTOK = tokens_sql("doc_id", f"(SELECT doc_id, concat_ws(' ', {PATH_SQL}, n, n, n, n) AS p FROM (SELECT *, concat('doc_', doc_id, '.txt') AS n FROM documents))", "p", "pt")
BLEND = "nting thing en doc"


@query(f"""WITH {SCORED}, {PATHTOK},
ppost AS (SELECT t AS term, doc_id, count(*) AS tf FROM pt GROUP BY ALL), plens AS (SELECT doc_id, sum(tf) AS len FROM ppost GROUP BY ALL),
pstat AS (SELECT (SELECT n FROM stat) AS n, sum(len) / (SELECT n FROM stat) AS mean FROM plens), pdfs AS (SELECT term, count(*) AS df FROM ppost GROUP BY term),
both_ AS (SELECT doc_id, {ONE} AS s FROM post JOIN dfs USING (term) JOIN lens USING (doc_id), stat WHERE term IN ('nting', 'thing', 'en', 'doc')
  UNION ALL SELECT doc_id, 0.5 * {ONE} FROM ppost JOIN pdfs USING (term) JOIN plens USING (doc_id), pstat WHERE term IN ('nting', 'thing', 'en', 'doc'))
SELECT doc_id, round(sum(s), 6) AS score FROM both_ GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""")
def bm25_path_blend(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty best documents by content and half the path score."""
    found = I.asked(text_index(spark, folder), {"q": BLEND})
    return found.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"WITH {SCORED} SELECT doc_id, round(sum({ONE}), 6) AS score FROM post JOIN dfs USING (term) JOIN lens USING (doc_id), stat WHERE term IN ('nting', 'thing', 'ererly') GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for one query, by content."""
    found = I.asked(text_index(spark, folder), {"q": "nting thing ererly"}, paths=False)
    return found.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query()
def text_search(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked search with a boolean expression, a language filter, boosts and snippets."""
    return S.search(files(spark, folder), text_index(spark, folder), '(nting OR thing) AND "of the" lang:en')


@query()
def text_search_fast(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked search of plain words with intent expansion: texts are read for the final rows only."""
    return S.search(files(spark, folder), text_index(spark, folder), "thing nting token", intent_mode=True)


def _matching(spark: SparkSession, folder: str, text: str) -> DataFrame:
    parsed = Q.parse(text)
    cond = Q.filter_condition(parsed.filter, F.col("path"), F.col("language"))
    if parsed.expr is not None:
        cond = cond & Q.condition(parsed.expr, F.lower("text"))
    return files(spark, folder).where(cond).select(F.col("doc").alias("doc_id"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'thing') AND contains(lower(text), 'nting')")
def boolean_and(spark: SparkSession, folder: str) -> DataFrame:
    return _matching(spark, folder, "thing AND nting")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'thing') OR NOT contains(lower(text), 'the')")
def boolean_not(spark: SparkSession, folder: str) -> DataFrame:
    return _matching(spark, folder, "thing -the")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'that the') OR contains(lower(text), 'de la')")
def phrase_search(spark: SparkSession, folder: str) -> DataFrame:
    return _matching(spark, folder, '"that the" OR "de la"')


@query(f"SELECT doc_id FROM documents WHERE lang = 'de' AND contains({PATH_SQL}, 'src1') AND {PATH_SQL} LIKE '%.txt' AND contains(lower(text), 'der')")
def query_filter_lang(spark: SparkSession, folder: str) -> DataFrame:
    return _matching(spark, folder, "der lang:DE file:src1 ext:txt")


LINES = "SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS raw, generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) AS line_number FROM documents"


@query(f"WITH l AS ({LINES}) SELECT doc_id, line_number::INTEGER AS line_number, instr(raw, 'Thing')::INTEGER AS column_start, raw AS line FROM l WHERE contains(raw, 'Thing')")
def grep_literal(spark: SparkSession, folder: str) -> DataFrame:
    """All lines with a literal."""
    return S.grep(files(spark, folder).withColumnRenamed("doc", "doc_id"), "Thing", limit=None, key="doc_id").select("doc_id", "line_number", "column_start", "line")


@query(f"""WITH l AS ({LINES}), c AS (SELECT *, string_agg(raw, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b,
string_agg(raw, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS a FROM l)
SELECT doc_id, line_number::INTEGER AS line_number, coalesce(b, '') AS before, coalesce(a, '') AS after FROM c WHERE contains(raw, 'token')""")
def grep_context(spark: SparkSession, folder: str) -> DataFrame:
    """All lines with a literal, with two lines before and after."""
    found = S.grep(files(spark, folder).withColumnRenamed("doc", "doc_id"), "token", before=2, after=2, limit=None, key="doc_id")
    return found.select("doc_id", "line_number", F.array_join("context_before", "\n").alias("before"), F.array_join("context_after", "\n").alias("after"))


@query(f"""WITH l AS ({LINES}), h AS (SELECT doc_id, min(line_number) AS c FROM l WHERE contains(lower(raw), 'thing') OR contains(lower(raw), 'keit') GROUP BY doc_id)
SELECT doc_id, greatest(c - 3, 1)::INTEGER AS line_start, max(line_number)::INTEGER AS line_end, string_agg(raw, chr(10) ORDER BY line_number) AS snippet FROM l JOIN h USING (doc_id) WHERE line_number BETWEEN greatest(c - 3, 1) AND c + 3 GROUP BY doc_id, c""")
def snippet_first_hit(spark: SparkSession, folder: str) -> DataFrame:
    """The lines about the first hit of two words."""
    words = F.array(F.lit("thing"), F.lit("keit"))
    hit = files(spark, folder).where(F.lower("text").contains("thing") | F.lower("text").contains("keit"))
    return hit.select(F.col("doc").alias("doc_id"), S.snippet(F.col("text"), words).alias("s")).select("doc_id", "s.line_start", "s.line_end", "s.snippet")


@query("""WITH c AS (SELECT doc_id, contains(lower(text), 'thing')::INTEGER + contains(lower(text), 'nting')::INTEGER + contains(lower(text), 'keit')::INTEGER AS k FROM documents)
SELECT doc_id, round(1.0 + pow(k / 3.0, 1.5) * 2.0, 9) AS boost FROM c""")
def coverage_boost(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).select(F.col("doc").alias("doc_id"), F.round(P.coverage_boost("text", ["thing", "nting", "keit"]), 9).alias("boost"))


CATEGORY = """CASE WHEN regexp_matches(p, '(\\.cargo/registry|deps|external|third-party|third_party|node_modules|vendor)/') THEN 'vendor'
WHEN regexp_matches(p, 'generated/|/gen/') THEN 'generated' WHEN regexp_matches(p, '(testing|__tests?__|specs?|tests?)/') OR regexp_matches(name, '^(test|spec)_') THEN 'test'
WHEN name LIKE '.%' THEN 'config' WHEN regexp_matches(p, '(documentation|docs?)/') THEN 'documentation' ELSE 'source' END"""


@query(f"WITH u AS (SELECT page_id, lower(url) AS p, lower(split_part(url, '/', -1)) AS name FROM pages) SELECT page_id, {CATEGORY} AS category FROM u")
def file_category(spark: SparkSession, folder: str) -> DataFrame:
    """Categories of the addresses of pages."""
    return table(spark, folder, "pages").select("page_id", P.file_category("url").alias("category"))


@query(f"WITH u AS (SELECT lang, source, lower({PATH_SQL}) AS p, concat('doc_', doc_id, '.txt') AS name, n_chars FROM documents) SELECT {CATEGORY} AS category, lang AS language, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM u GROUP BY ALL")
def category_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).groupBy(P.file_category("path").alias("category"), "language").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


KEYWORDS = "list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) >= 3 AND regexp_full_match(t, '[a-z_][a-z0-9_]*') AND t NOT IN ({}))".format(", ".join(f"'{w}'" for w in sorted(T.KEYWORD_STOPS)))
PAIRED = f"""WITH k AS (SELECT conv_id, turn, list_distinct({KEYWORDS}) AS ks FROM conversations),
p AS (SELECT a.conv_id, b.turn, a.ks AS q, b.ks AS c, len(list_intersect(a.ks, b.ks)) AS hits FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn's keywords and those of the turn before."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", T.keywords("text", None).alias("c"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("c").alias("q"))
    return turns.join(before, ["conv_id", "turn"])


@query(PAIRED + " SELECT conv_id, turn, round(CASE WHEN len(q) > 0 AND len(c) > 0 THEN hits / greatest(len(q), len(c)) ELSE 0.0 END, 9) AS overlap FROM p")
def keyword_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return _turns(spark, folder).select("conv_id", "turn", F.round(T.keyword_overlap("q", "c"), 9).alias("overlap"))


@query(PAIRED + " SELECT conv_id, turn, round(CASE WHEN len(q) > 0 AND len(c) > 0 THEN hits / len(q) ELSE 0.0 END, 9) AS coverage FROM p")
def keyword_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return _turns(spark, folder).select("conv_id", "turn", F.round(T.keyword_coverage("q", "c"), 9).alias("coverage"))


@query("SELECT lang AS language, count(*) AS files, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang UNION ALL SELECT NULL, count(*), sum(length(text))::BIGINT FROM documents")
def extract_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Files and characters by language and in all."""
    return files(spark, folder).rollup("language").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("text")).alias("chars"))
