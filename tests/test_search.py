"""BM25, text search, grep, vector search, fusion."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from textquarry.operators import rescoring as B
from textquarry.operators import text_index as I
from textquarry.operators import text_search as S
from textquarry.operators import vector_search as V
from textquarry.plans import catalog

FILES = [
    (1, "src/auth/token.py", "python", "def authentication(token):\n    check(token)\n    return authentication"),
    (2, "src/db.py", "python", "database query\nuser"),
    (3, "tests/test_auth.py", "python", "authentication token token"),
    (4, "README.md", "markdown", "how to handle tokens"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "doc long, path string, language string, text string")


@pytest.fixture(scope="module")
def index(files):
    return I.build(files)


def test_bm25_by_hand(spark, index):
    got = {r.doc: r.score for r in I.asked(index, {"q": "token"}, paths=False).collect()}
    size = {r.doc: r.doc_len for r in index.docs.collect()}
    mean = sum(size.values()) / 4
    idf = math.log(1 + (4 - 2 + 0.5) / (2 + 0.5))
    want = {d: idf * tf * 2.5 / (tf + 1.5 * (0.5 + 0.5 * size[d] / mean)) for d, tf in ((1, 2), (3, 2))}
    assert got == pytest.approx(want)


def test_bm25_of_nothing(spark, index):
    assert I.asked(index, {"q": ""}).collect() == [] and I.asked(index, {"q": "zzz"}).collect() == []


def test_search_ranks_and_filters(files, index):
    found = [r.path for r in S.search(files, index, "authentication token").collect()]
    assert found[0] == "src/auth/token.py" and "tests/test_auth.py" in found
    assert [r.path for r in S.search(files, index, "token lang:markdown tokens").collect()] == ["README.md"]
    assert {r.path for r in S.search(files, index, "authentication AND check").collect()} == {"src/auth/token.py"}
    first = S.search(files, index, "user").first()
    assert (first.path, first.snippet, first.line_start, first.line_end, first.truncated) == ("src/db.py", "database query\nuser", 1, 2, False)
    assert S.search(files, index, "authentication token", limit=1).first().truncated


def test_intent_widens(files, index):
    assert [r.path for r in S.search(files, index, "login", limit=5).collect()] == []
    assert {r.path for r in S.search(files, index, "login", intent_mode=True).collect()} >= {"src/auth/token.py"}


def test_index_round_trip(spark, index, tmp_path):
    index.write(str(tmp_path))
    again = I.read(spark, str(tmp_path))
    assert sorted(map(tuple, again.postings.collect())) == sorted(map(tuple, index.postings.collect()))


def test_index_tasks_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(I, "PART_BYTES", 4000, raising=False)
    rows = spark.range(400).select(F.col("id").alias("doc"), F.lit(f"a/{'b' * 60}.txt").alias("path"), F.lit("en").alias("language"), F.concat(F.repeat(F.lit("word "), 40), "id").alias("text"))
    index = I.build(rows, whole=True)
    for postings in (index.postings, index.path_postings):
        held = postings.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("doc").alias("n")).collect()
        assert sum(r.n for r in held) == 400 and max(r.n for r in held) < 100
    assert index.docs.agg(F.sum("doc_len")).first()[0] == 400 * 40 + 390  # numbers of one digit are no token


def test_scores_of_a_table_of_queries_are_bounded(spark, monkeypatch):
    rows = spark.range(400).select(F.col("id").alias("doc"), F.lit("a").alias("path"), F.lit("en").alias("language"), F.concat(F.lit("alpha beta "), F.repeat(F.lit("gamma "), (F.col("id") % 7).cast("int"))).alias("text"))
    index = I.build(rows, whole=True)
    queries = spark.range(20).select(F.concat(F.lit("q"), "id").alias("query"), F.posexplode(F.split(F.lit("alpha gamma zeta"), " ")).alias("pos", "term"))
    want = {(r.query, r.doc): r.score for r in I.bm25(index, queries, paths=False).collect()}
    assert len(want) == 8000
    for rows_at_once in (200_000, 0):  # the queries broadcast, and joined by term
        monkeypatch.setattr(I, "PAIRS", 500, raising=False)
        monkeypatch.setattr(I, "QUERY_TERMS", rows_at_once, raising=False)
        found = I.bm25(index, queries, paths=False)
        assert {(r.query, r.doc): r.score for r in found.collect()} == pytest.approx(want)
        assert max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) < 1500
    both = {(r.query, r.doc): tuple(r.matched) for r in I.bm25(index, queries).collect()}
    assert len(both) == 8000 and set(both.values()) == {("alpha",), ("alpha", "gamma")}


def test_index_of_nothing(spark):
    none = spark.createDataFrame([(1, "a", "x", None)], "doc long, path string, language string, text string")
    assert I.build(none).postings.count() == 0 and I.build(none.limit(0), whole=True).docs.count() == 0
    assert [tuple(r) for r in I.build(none, whole=True).docs.select("doc", "doc_len").collect()] == [(1, 0)]


def test_index_leaves_out(spark):
    rows = spark.createDataFrame([(1, "a", "x", "nul\x00"), (2, "b", "x", None), (3, "c", "x", "fine")], "doc long, path string, language string, text string")
    assert [r.doc for r in I.build(rows).docs.collect()] == [3]


def test_grep(spark):
    rows = spark.createDataFrame([("b", "one\nTwo two\nthree"), ("a", "two\r\nx\n"), ("c", "none"), ("d", None)], "path string, text string")
    got = [tuple(r) for r in S.grep(rows, "two", before=1, after=1).collect()]
    assert got == [("a", 1, 1, 4, "two", [], ["x"]), ("b", 2, 5, 8, "Two two", ["one"], ["three"])]
    assert S.grep(rows, "two", limit=1).count() == 1


def test_nearest_in_passes_and_apart(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0], str(i % 3)) for i in range(60)] + [(99, None, "0")], "vec_id long, embedding array<float>, label string")
    q = spark.createDataFrame([(str(i), [1.0 * i, 2.0, 1.0]) for i in range(3)], "query_id string, query_vector array<double>")
    one = sorted(map(tuple, V.knn(rows, q, 5, metric="dot").collect()))
    monkeypatch.setattr(V, "QUERY_ROWS", 1)
    assert sorted(map(tuple, V.knn(rows, q, 5, metric="dot").collect())) == one and len(one) == 15
    apart = V.knn(rows, q, 5, apart="label").join(rows, "vec_id").collect()
    assert len(apart) == 15 and all(r.label != r.query_id for r in apart)


def test_late_interaction_in_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5)], i % 3) for i in range(60)], "vec_id long, embedding array<float>, label int")
    q = rows.where("vec_id % 10 = 0").select(F.col("label").alias("query_id"), "vec_id", F.col("embedding").alias("query_vector"))
    found = {(r.query_id, r.label): r.score for r in V.maxsim_of_sets(rows, q, block=7).collect()}
    held = [(r.vec_id, r.embedding, r.label) for r in rows.collect()]
    want = {}
    for i, v, a in held:
        for b in range(3) if i % 10 == 0 else ():
            want[a, b] = want.get((a, b), 0) + max(v[0] * w[0] + v[1] * w[1] for _, w, c in held if c == b)
    assert found == pytest.approx(want)


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 1.0])], "query_id long, query_vector array<double>")
    order = lambda m: [r.vec_id for r in V.knn(rows, q, 4, metric=m).orderBy("rank").collect()]
    assert order("cosine") == [3, 1, 2, 4] and order("dot") == [3, 2, 1, 4] and order("euclid") == [1, 2, 4, 3]
    assert [round(x, 6) for x in rows.where("vec_id = 3").select(V.normalised("embedding")).first()[0]] == [0.707107] * 2
    sets = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[2.0, 0.0], [0.5, 0.5]])], "q array<array<double>>, d array<array<double>>")
    assert sets.select(V.maxsim("q", "d")).first()[0] == 2.5


def test_rrf_and_artifact(spark):
    lists = spark.createDataFrame([(0, 0, "code", 1, 0.9, "function"), (0, 1, "art", 1, 0.9, "file_artifact")], "query_id int, list int, key string, rank int, score double, kind string")
    got = {r.key: r.score for r in V.rrf(lists, {0: 0.5, 1: 0.5}).collect()}
    assert got["art"] > got["code"] == pytest.approx(0.5 / 61 + 0.05)


def test_diversify_and_overfetch(spark):
    rows = spark.createDataFrame([(0, "1", "a.py", 1), (0, "2", "a.py", 2), (0, "3", "b.py", 3)], "query_id int, key string, file_path string, rank int")
    assert " ".join(r.file_path for r in V.diversify(rows, 3).orderBy("place").collect()) == "a.py b.py a.py"
    assert [V.overfetch(5, hybrid=True), V.overfetch(10, hybrid=True), V.overfetch(5, 15, hybrid=True)] == [16, 30, 18]


def test_rerank_blend(spark):
    rows = spark.createDataFrame([(0, "a", 1.0, 0.0), (0, "b", 0.5, 2.0)], "query_id int, key string, score double, rerank_score double")
    assert {r.key: r.blended for r in V.rerank_blend(rows).collect()} == pytest.approx({"a": 0.75, "b": 0.625})


def test_structured():
    parts = V.structured("lex: auth token\nplain\nhyde: an answer\n")
    assert [(p.kind, p.text) for p in parts] == [("lex", "auth token"), ("vec", "plain"), ("hyde", "an answer")]
    assert V.structured_weights(parts) == {0: 2.0, 1: 1.0, 2: 1.0}


POINT = {"symbol_name": "run", "symbol_kind": "other", "file_path": "lib/x.rb", "keywords": None, "score": 0.5, "path_context": None, "role": None, "signature": None, "parent": None, "description": None, "docstring": None}
SCHEMA = "symbol_name string, symbol_kind string, file_path string, keywords array<string>, score double, path_context string, role string, signature string, parent string, description string, docstring string"


@pytest.mark.parametrize(
    ("asked", "changed", "want"),
    [
        ([], {}, 0.5),
        (["alpha"], {"keywords": ["alpha", "beta"]}, 0.5 * 0.7 + 0.5 * 0.3 + 0.16),
        (["alpha"], {"path_context": "src/alpha.py"}, 0.5 + 0.1 + 0.16),
        (["zeta"], {"symbol_kind": "function"}, 0.5 * 1.12),
        (["zeta", "eta"], {"symbol_kind": "variable"}, 0.5 * 0.8 * 0.7),
        (["zeta", "eta"], {"file_path": "tests/x.rb"}, 0.5 * 0.3),
        (["zeta", "tests"], {"file_path": "lib/x_test.py"}, 0.5),
        (["zeta", "eta"], {"file_path": "scripts/x.rb"}, 0.5 * 0.68),
        (["zeta", "eta"], {"file_path": "x.json"}, 0.5 * 0.82),
        (["alpha", "zeta"], {"file_path": "lib/alpha.rb"}, 0.5 + 0.5 * 0.16),  # one word of a base name isn't enough
        (["alpha", "beta"], {"file_path": "lib/alpha_beta.rb"}, 0.5 + 0.16 + 0.16),
        (["provider", "lazy"], {"file_path": "a/providers/factory.py"}, (0.5 + 0.09) + 0.5 * 0.16),
        (["import"], {"file_path": "graph/imports.rb"}, 0.5 + 3 * 0.025 + 0.16),
        (["callers"], {"symbol_name": "trace_edges"}, 0.5 + 3 * 0.02),
        (["zeta"], {"role": "logic"}, 0.5),  # only for questions about actions or scopes
        (["delete"], {"role": "logic"}, 0.5 + 0.04),
        (["delete"], {"role": "test"}, 0.5 - 0.04),
        (["delete"], {"symbol_name": "delete"}, 0.5 + 0.18 + 0.08 + 0.16),
        (["zeta"], {"symbol_name": "path_bonus"}, 0.5 * 0.25),
        (["ranking"], {"symbol_name": "path_bonus"}, 0.5),
        (["parser", "startup"], {"symbol_kind": "import"}, 0.5 * 0.8 * 0.45 * 0.7),
        (["parser", "startup"], {"file_path": "a/providers/x.rb"}, 0.5 * 0.2),
        (["zeta", "eta"], {"symbol_name": "__init__"}, 0.5 * 0.55),
        (["zeta", "eta"], {"symbol_kind": "class", "symbol_name": "QueryResult"}, 0.5 * 1.12),
        (["create", "eta"], {"symbol_kind": "class", "symbol_name": "QueryResults"}, 0.5 * 1.12 * 0.72),
        (["alpha", "beta", "eta"], {"docstring": "alpha beta"}, (0.5 + 2 / 3 * 0.16) * 1.08),
        (["alpha", "beta"], {"symbol_name": "alphaBeta"}, (0.5 + 0.18) * 1.12 + 0.16),
        (["zeta", "eta"], {"symbol_name": "main"}, 0.5 * 0.92),
        (["removed"], {"symbol_name": "delete"}, 0.5 + 0.18 + 0.16),  # a synonym
    ],
)
def test_rescoring_terms(spark, asked, changed, want):
    rows = spark.createDataFrame([tuple((POINT | changed).values())], SCHEMA)
    assert B.rescore(rows, asked).first().score == pytest.approx(want)


def test_rescore_and_filters(spark):
    rows = spark.createDataFrame([("login", "function", "src/auth.py", ["auth", "login"], 0.5), ("login", "variable", "tests/test_auth.py", ["auth"], 0.5)], "symbol_name string, symbol_kind string, file_path string, keywords array<string>, score double")
    a, b = (r.score for r in B.rescore(rows, ["auth", "login"]).collect())
    assert a > b > 0
    rule = B.Rule(0.5, ("lib/auth.py", "src/auth.py"), ("login",), (frozenset({"auth"}),), frozenset({"other"}), adds=False)
    up = [r.score for r in B.rescore(rows, ["auth", "login"], rules=[rule]).collect()]
    assert up[0] < a and up[1] == pytest.approx(b)
    assert B.rescore(rows, ["login", "other"], rules=[rule]).collect() == B.rescore(rows, ["login", "other"]).collect()
    p = rows.withColumn("path_prefixes", F.array(F.lit("src"), F.lit("src/auth.py"))).withColumn("language", F.lit("python"))
    assert p.where(V.payload_filter(language="python", prefix="src", kinds=["function"])).count() == 1


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_path_blend", "bm25_batch_benchmark"])
def test_registered_queries_count_every_document(spark, tmp_path, name):
    rows = [(i, f"thing nting word{i}", "en", "s") for i in range(8)] + [(20, "thing " + "filler " * 400_000, "en", "s"), (21, "nting\x00thing", "en", "s"), (22, None, "en", "s")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nting thing"), (2, "word3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = catalog.queries()[name](spark, str(tmp_path))
    rel = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(rel.fetchall())
