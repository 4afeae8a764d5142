"""Tokenisers, query language, intent, path functions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textquarry.functions import intent as N
from textquarry.functions import paths as P
from textquarry.functions import query as Q
from textquarry.functions import tokens as T
from textquarry.functions.intent import stem


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


@pytest.mark.parametrize(("word", "parts"), [("getUserById", "get user by id"), ("parseJSONToHTML", "parse json to html"), ("oauth2", "oauth 2"), ("snake_case_name", "snake case name"), ("Id", "Id"), ("__x", "x")])
def test_split_word(spark, word, parts):
    assert T.split_word_py(word) == parts.split()
    assert column(spark, [word], T.split_word) == [parts.split()]


def test_stop_words_and_preserved(spark):
    assert "working" in T.query_tokens("the function is not working") and T.query_tokens("the function is not working") == ["working"]
    assert T.query_tokens("OAuth2 JWT GraphQL") == ["oauth2", "jwt", "graphql"]
    assert column(spark, ["user user user admin"], T.tokens) == [["user", "user", "user", "admin"]]
    assert column(spark, ["async asyncCall", None, ""], T.tokens) == [["async", "call"], None, []]


def test_tokens_as_in_the_driver(spark):
    rng = random.Random(1)
    letters = "abcXYZ019_ .-ÄäßéÉ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(300)]
    assert column(spark, texts, T.unique_tokens) == [T.query_tokens(t) for t in texts]
    assert column(spark, texts, lambda c: T.keywords(c)) == [T.keywords_py(t) for t in texts]
    assert column(spark, texts, T.symbol_tokens) == [T.symbol_tokens_py(t) for t in texts]


def test_query_language():
    e = Q.parse("auth AND token").expr
    assert isinstance(e, Q.And)
    assert isinstance(Q.parse("auth OR token").expr, Q.Or) and isinstance(Q.parse("auth token").expr, Q.Or)
    e = Q.parse("(auth OR token) AND handler").expr
    assert isinstance(e, Q.And) and isinstance(e.left, Q.Or)
    q = Q.parse("auth file:main.rs lang:rust")
    assert (q.filter.file, q.filter.lang) == ("main.rs", "rust") and q.expr == Q.Term(["auth"])
    e = Q.parse("a b AND c").expr
    assert isinstance(e, Q.And) and isinstance(e.left, Q.Or)
    assert Q.parse('"two words" -test +must').expr == Q.Or(Q.Or(Q.Term(["two", "words"], exact=True), Q.Term(["test"], excluded=True)), Q.Term(["must"], required=True))
    assert Q.parse("").expr is None and Q.parse("lang:go").expr is None and Q.parse(")").expr is None


@pytest.mark.parametrize(("text", "held"), [("alpha AND beta", [True, False, False]), ("alpha OR beta", [True, True, False]), ("alpha -beta", [True, True, True]), ('"beta alpha"', [False, False, False]), ('"alpha beta"', [True, False, False]), ("-alpha", [False, False, True])])
def test_query_condition(spark, text, held):
    assert column(spark, ["Alpha Beta", "ALPHA", "gamma"], lambda c: Q.condition(Q.parse(text).expr, F.lower(c))) == held


def test_fast_path():
    assert Q.plain(Q.parse("a b c").expr) and not Q.plain(Q.parse("a -b").expr) and not Q.plain(Q.parse("a AND b").expr)


def test_intent():
    assert "authentication" in N.expand_query("auth", 2) and "login" in N.expand_query("auth", 2)
    assert N.intent("auth AND token", 3).expanded == [] and N.intent("a-b", 3).expanded == []
    assert len(N.intent("auth", 1).expanded) <= 6 and len(N.intent("auth user db", 3).expanded) <= 24
    assert N.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert N.stem("caching") == N.stem("cache")


@pytest.mark.parametrize(("path", "category"), [("src/main.rs", "source"), ("tests/test_auth.py", "test"), ("Cargo.toml", "config"), ("README.md", "documentation"), ("api.pb.go", "generated"), ("vendor/lib/foo.go", "vendor"), (".env", "config"), ("a\\b\\foo.test.js", "test"), ("docs/x.py", "documentation")])
def test_file_category(spark, path, category):
    assert column(spark, [path], P.file_category) == [category]


def test_paths(spark):
    assert column(spark, ["a/b.py", "x.tar.GZ", "Main.RS", "noext"], P.detect_language) == ["python", None, "rust", None]
    assert column(spark, ["A/b/c.py"], T.path_prefixes) == [["a", "a/b", "a/b/c.py"]]
    assert column(spark, ["a/b/c/d/e/f/g.py"], T.path_context) == ["c/d/e/f/g.py"]
    assert column(spark, ["src/auth/login_handler.py"], T.path_tokens) == [["auth", "login", "handler"]]


def test_boosts(spark):
    assert column(spark, ["auth token", "auth", ""], lambda c: F.round(P.coverage_boost(c, ["auth", "token"]), 6)) == [3.0, round(1 + 0.5**1.5 * 2, 6), 1.0]
    assert column(spark, ["if (a && b) { for (x) { while (y) z ? 1 : 2 } } alpha beta gamma delta"], P.content_role) == ["orchestration"]
    assert column(spark, [["import", "import", "class"], ["class"], []], lambda c: P.file_role(c, F.lit("x")), "array<string>") == ["import", "definition", "implementation"]


def test_keyword_scores(spark):
    rows = spark.createDataFrame([(["A", "b", "c"], ["a", "d"]), ([], ["a"]), (["a"], ["a"])], "q array<string>, c array<string>")
    found = rows.select(T.keyword_overlap("q", "c"), T.keyword_coverage("q", "c")).collect()
    assert [tuple(round(x, 6) for x in r) for r in found] == [(0.333333, 0.333333), (0.0, 0.0), (1.0, 1.0)]


def test_stems():
    """Pairs from the published vocabulary of the algorithm."""
    want = "consign:consign consigned:consign consistency:consist knightly:knight knights:knight running:run generously:generous generate:generat caresses:caress ponies:poni ties:tie hopping:hop hoping:hope agreed:agre happy:happi cry:cri by:by say:say sky:sky skis:ski national:nation relational:relat conditional:condit vietnamization:vietnam formalize:formal electrical:electr hopeful:hope goodness:good adjustment:adjust adoption:adopt controlling:control rate:rate fall:fall succeed:succeed communism:communism"
    assert {w.split(":")[0]: stem(w.split(":")[0]) for w in want.split()} == dict(w.split(":") for w in want.split())


def test_variants(spark):
    found = spark.createDataFrame([(w,) for w in ("queries", "running", "stored", "boxes", "classes", "class", "is", "snippets")], "w string").select("w", T.variants(F.col("w"))).collect()
    assert dict(map(tuple, found)) == {"queries": ["queries", "query"], "running": ["running", "runn", "run"], "stored": ["stored", "store", "persisted", "stor", "store"], "boxes": ["boxes", "box"], "classes": ["classes", "class"], "class": ["class"], "is": [], "snippets": ["snippets", "source", "snippet", "source"]}
    assert spark.range(1).select(T.identifier_tokens(F.lit("src/QueryRunner_v2.indexed"), 6)).first()[0] == ["src", "query", "runner", "indexed", "index", "stored"]
