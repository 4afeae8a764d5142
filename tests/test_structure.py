"""Symbols, graphs, hygiene, incremental state, protocol, packing, edits, patterns, composition, sources, streaming."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from textquarry.operators import compose as C
from textquarry.operators import edits as E
from textquarry.operators import graphs as G
from textquarry.operators import hygiene as H
from textquarry.operators import incremental as N
from textquarry.operators import packing as K
from textquarry.operators import patterns as X
from textquarry.operators import protocol as R
from textquarry.operators import symbols as Y
from textquarry.sources import files as L
from textquarry.sources.snapshots import Manifest, Snapshots, collections, fingerprint
from textquarry.streaming import feed

PY = '''import os
from pkg.util import helper

LIMIT = 3


class Store:
    """Keeps things."""

    def __init__(self, path):
        self.path = path

    def connect(self, retries: int = 1) -> bool:
        return helper(self.path)


def main():
    store = Store("x")
    return store.connect()
'''
FILES = [("app/main.py", "python", PY), ("pkg/util.py", "python", "def helper(p):\n    return p\n\n\ndef _quiet():\n    return helper(1)\n"), ("web/a.ts", "typescript", "import { b } from './b';\nexport class A {\n  run() {}\n}\n"), ("web/b.ts", "typescript", "export function b() { return 1 }\n"), ("bad.py", "python", "def (:\n"), ("x.json", "json", '{"name": 1, "deep": {"k": 2}}')]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "file_path string, language string, text string")


@pytest.fixture(scope="module")
def symbols(files):
    return Y.extract(files).withColumn("symbol_id", F.xxhash64("file_path", "name", "byte_start")).cache()


def test_python_symbols(symbols):
    got = {(r.name, r.kind, r.parent, r.line_start, r.line_end) for r in symbols.where("file_path = 'app/main.py'").collect()}
    assert got == {("os", "import", None, 1, 1), ("pkg.util", "import", None, 2, 2), ("LIMIT", "constant", None, 4, 4), ("Store", "class", None, 7, 14), ("__init__", "constructor", "Store", 10, 11), ("connect", "method", "Store", 13, 14), ("main", "function", None, 17, 19)}
    r = symbols.where("name = 'connect'").first()
    assert (r.signature, r.return_type, r.params) == ("def connect(self, retries: int = 1) -> bool:", "bool", "self, retries")
    assert PY.encode()[r.byte_start : r.byte_end].decode().startswith("def connect") and symbols.where("name = 'Store'").first().docstring == "Keeps things."


def test_other_symbols_errors_roles(files, symbols):
    assert {(r.name, r.kind) for r in symbols.where("language = 'typescript'").collect()} == {("./b", "import"), ("A", "class"), ("b", "function")}
    assert {r.name for r in symbols.where("language = 'json'").collect()} == {"name", "deep"}
    assert [r.file_path for r in Y.errors(files).collect()] == ["bad.py"]
    roles = {r.name: r.role for r in symbols.collect()}
    assert (roles["main"], roles["_quiet"], roles["LIMIT"], roles["helper"], roles["os"]) == ("entrypoint", "utility", "definition", "logic", "definition")
    html = Y.parse("<html><title>Hi  there</title><h1 id='x'>Big</h1><p id='para'>x</p></html>", "html")
    assert [(s["name"], s["kind"]) for s in html] == [("Hi there", "heading"), ("Big", "heading"), ("para", "html_tag")]
    assert [s["name"] for s in Y.parse("# One\ntext\n## Two ##\n", "markdown")] == ["One", "Two"]


def test_lookup(symbols):
    assert Y.lookup(symbols, "connect").first().name == "connect"
    assert Y.lookup(symbols, "Store.connect").first().name == "connect"
    assert Y.symbol(symbols, "store.CONNECT").count() == 1
    assert Y.qualified("crate::module::symbol_name") == ("crate::module", "symbol_name")
    assert [r.name for r in Y.file_symbols(symbols, "pkg/util.py").collect()] == ["helper", "_quiet"]


def test_nested_enclosing_skeleton(spark, files, symbols):
    rows = spark.createDataFrame([("f", "a", "function", 0, 100), ("f", "a", "function", 10, 20), ("f", "b", "function", 10, 20)], "file_path string, name string, kind string, byte_start long, byte_end long")
    assert sorted((r.name, r.byte_start) for r in Y.drop_nested(rows).collect()) == [("a", 0), ("b", 10)]
    ranges = spark.createDataFrame([("f", 1, 0, 100), ("f", 2, 10, 20), ("g", 3, 0, 5)], "file_path string, symbol_id long, byte_start long, byte_end long")
    points = spark.createDataFrame([(1, "f", 15), (2, "f", 50), (3, "g", 9)], "point_id long, file_path string, at long")
    assert {r.point_id: r.symbol_id for r in Y.enclosing(points, ranges).collect()} == {1: 2, 2: 1, 3: None}
    tree = {r.dir: (r.file_count, r.symbol_count) for r in Y.skeleton(files, symbols).collect()}
    assert tree[""][0] == 6 and tree["app"] == (1, 5) and tree["web"][0] == 2
    assert Y.render([("a/b.py", ["def f()"]), ("c.py", [])]) == "├── a/\n│   └── b.py\n│       def f()\n└── c.py"
    assert {r.language: r.files for r in Y.extract_stats(symbols, files).collect()}[None] == 6


def test_imports(files):
    got = {(r.source_file, r.target_file, r.line) for r in G.import_edges(files).collect()}
    assert got == {("app/main.py", "pkg/util.py", 2), ("web/a.ts", "web/b.ts", 1)}
    edges = G.import_edges(files)
    assert [(r.relation, r.other_file) for r in G.neighbours(edges, "pkg/util.py").collect()] == [("imported_by", "app/main.py")]


@pytest.mark.parametrize(("language", "statement", "module"), [("python", "from ..a.b import c", "..a.b"), ("python", "import x.y, z", "x.y"), ("javascript", "const a = require('./m')", "./m"), ("rust", "use crate::x::Y;", "crate"), ("go", 'import "fmt"', "fmt"), ("java", "import static a.b.C;", "a.b.C"), ("csharp", "using X = A.B;", "A.B"), ("c", '#include "a/b.h"', "a/b.h")])
def test_parse_import(spark, language, statement, module):
    row = spark.createDataFrame([(language, statement)], "l string, s string")
    assert row.select(G.parse_import(F.col("s"), F.col("l"))).first()[0] == module


def test_calls_and_traces(spark, symbols):
    sites = G.call_sites(symbols)
    assert [(r.file_path, r.caller) for r in G.callers(symbols, sites, "helper").collect()] == [("app/main.py", "connect"), ("pkg/util.py", "_quiet")]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a"), ("e", "e")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    got = {r.node: r.level for r in G.trace(spark, edges, start, depth=2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    assert {r.node: r.level for r in G.trace(spark, edges, start, direction="upstream").collect()} == {"a": 0, "c": 1, "x": 1, "b": 2}
    assert {r.node for r in G.trace(spark, edges, start, direction="both").collect()} == {"a", "b", "c", "d", "x"}
    assert {tuple(r.nodes) for r in G.cycles(edges).collect()} == {("e",), ("a", "b", "c")}
    assert {r.node: (r.fan_in, r.fan_out) for r in G.degrees(edges).collect()}["a"] == (2, 1)


CHUNK = "chunk_id string, source string, symbol_name string, symbol_kind string, file_path string, parent string, signature string, docstring string, byte_start long, byte_end long"


def test_sharing_is_whole_and_bounded(spark, monkeypatch):
    rows = [(i, f"/{t}") for i in range(300) for t in (0, i % 5, 5 + i % 7, 0)] + [(None, "/0"), (7, None), (50, "/0")]  # repeats, nulls
    of: dict[int, set] = {}
    for i, t in rows:
        if i is not None and t is not None:
            of.setdefault(i, set()).add(t)
    want = {(a, b, len(of[a] & of[b])) for a in of if a % 10 == 0 for b in of if a != b and len(of[a] & of[b]) >= 2}
    links = spark.createDataFrame(rows, "page_id long, href string")
    for pairs, asked in ((1_000_000, 200_000), (500, 25)):  # one pass, and several
        for name, value in (("PAIRS", pairs), ("ASKED", asked)):
            monkeypatch.setattr(G, name, value, raising=False)
        for kept in (links, links.distinct()):
            found = G.sharing(kept, kept.where("page_id % 10 = 0"), least=2)
            got = [tuple(r) for r in found.collect()]
            assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 1000 and max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) < 500
    assert G.sharing(links.limit(0), links.limit(0), least=2).collect() == []


def test_chunks(spark):
    rows = spark.createDataFrame([("1", "body", "f", "function", "a.py", None, "def f()", None, 0, 4), ("2", "body", "f", "function", "b.py", None, "def f()", None, 9, 13), ("3", "body", "f", "method", "c.py", "K", "def f()", None, 0, 4)], CHUNK)
    assert tuple(H.dedup_stats(rows).first()) == (3, 2, 1)
    assert [r.chunk_id for r in H.dedup(rows).where("is_representative").orderBy("chunk_id").collect()] == ["1", "3"]
    a = spark.createDataFrame([("1", "x", "connect", "method", "a.py", "K", "def connect(a)", None, 0, 4), ("2", "x", "connect", "method", "a.py", "K", "def connect(b)", None, 9, 13)], CHUNK)
    assert a.select(H.chunk_id(a)).distinct().count() == 2
    assert rows.select(H.description(rows)).first()[0].startswith("Function f in a.py")


def test_filter(spark):
    rows = [("s", "tiny", "a"), ("m", "x" * 1300, "a")] + [(f"k{i}", "def f():\n    return value\n" * (10 + i), "a") for i in range(4)]
    df = spark.createDataFrame(rows, "chunk_id string, source string, file_path string")
    assert tuple(H.filter_stats(df, per_file=3).first()) == (6, 3, 1, 1, 1, 1)
    assert {r.chunk_id for r in H.filter_chunks(df, per_file=3).collect()} == {"k1", "k2", "k3"}
    assert [r.chunk_id for r in H.global_cap(df, 1).collect()] == ["m"]
    cut = df.where("chunk_id = 'm'").select(H.truncated(F.col("source"), 100)).first()[0]
    assert len(cut) == 100 and cut.endswith("[truncated]")


def test_incremental(spark):
    keys = ("k",)
    old, new = (spark.createDataFrame(r, "k string, file_hash string") for r in ([("a", "1"), ("b", "1"), (None, "1")], [("b", "2"), ("c", "1"), (None, "1")]))
    assert {(r.k, r.status) for r in N.diff(old, new, keys=keys).collect()} == {("a", "deleted"), ("b", "modified"), ("c", "added"), (None, "unchanged")}
    expected = spark.createDataFrame([("a", "h", 2), ("b", "h", 2), ("c", "h", 1), ("d", "h", 0)], "file_path string, file_hash string, chunk_count long")
    stored = spark.createDataFrame([("a", "h", 2), ("b", "h", 1), ("d", "g", 3)], "file_path string, file_hash string, point_count long")
    assert {r.file_path: r.status for r in N.resume_pending(expected, stored).collect()} == {"a": "completed", "b": "pending", "c": "pending", "d": "delete_only"}
    f = spark.createDataFrame([("a", 1, 10), ("b", None, 10)], "file_path string, file_mtime long, file_size long")
    assert [r.file_path for r in N.changed_files(f, f.where("file_path = 'b'")).collect()] == ["a"]


def test_protocol(spark):
    text = 'const q = {\n  operationName: "GetUsers",\n  variables: { id: 1 }\n}\nconst r = http.post("/api/v2/orders/new", { body: order })\nreturn r.data.items\n'
    df = spark.createDataFrame([("a.js", text), ("b.js", "nothing here"), ("c.js", None)], "file_path string, text string")
    got = {r.transport: r for r in R.contracts(df).collect()}
    assert got["graphql"].operation_name == "GetUsers" and got["rest_post"].endpoint == "/api/v2/orders/new"
    assert R.contracts(df, min_score=20).collect() == [] and R.contracts(df, "zebra").collect() == []


def test_packing(spark):
    assert K.count_tokens("a bcdefgh, x") == 5
    df = spark.createDataFrame([(0, "a", 3.0, "m", "one two three"), (0, "b", 2.0, "m", "word here\n" * 500), (0, "c", 1.0, "m", "four five")], "query_id int, key string, score double, meta string, source string")
    got = {r.key: (r.truncated, r.tokens) for r in K.pack_greedy(df, 60, least=4).collect()}
    assert got["a"] == (False, 4) and got["b"][0] and sum(n for _, n in got.values()) <= 60
    assert df.select(K.tokens_of(F.col("source"))).first()[0] == K.count_tokens("one two three")
    source = '# top\n"""Doc."""\n\n\nimport a\nimport b\nimport c\n\n\ndef f():\n    # why\n    """Later."""\n    return 1\n'
    assert K.compress_source(source, "light", "python").count("\n\n\n") == 0
    assert K.compress_source(source, "medium", "python") == '"""Doc."""\n\nimport a\nimport b\nimport c\n\ndef f():\n    return 1'
    assert "import lines collapsed" in K.compress_source(source, "aggressive", "python")
    js = "/* first\n kept */\ncode();\n/* second\n gone */\n// gone\nmore();"
    assert K.compress_source(js, "medium", "javascript") == "/* first\n kept */\ncode();\nmore();"
    text = ("# Head\n" + "word " * 300 + "\n\n") * 8
    parts = K.chunk_text(text, 2000)
    assert "".join(text[a:b] for a, b in parts) == text and all(b - a <= 2000 for a, b in parts)


def test_signals(spark):
    df = spark.createDataFrame([("a.js", 'class UserService {}\nfunction loadUser() { api.fetch("a long enough string") }'), ("b.js", "class UserService {}")], "file_path string, text string")
    found = K.signals(df)
    kinds = {(r.file_path, r.kind, r.value) for r in found.collect()}
    assert ("a.js", "service", "UserService") in kinds and ("a.js", "method", "loadUser") in kinds and ("a.js", "call", "api.fetch") in kinds
    assert {r.file_path for r in K.packet(found).collect()} == {"a.js", "b.js"} and K.hotspots(found).count() >= 2


def test_edits(spark):
    text = "a\nb\nc"
    assert E.apply(text, [E.Edit("replace", "B\nB2", 2, 2), E.Edit("append", "d"), E.Edit("insert", "0", 1)]) == "0\na\nB\nB2\nc\nd"
    for bad in ([E.Edit("replace", "x", 1, 2), E.Edit("replace", "y", 2, 3)], [E.Edit("replace", "x", 3, 9)]):
        with pytest.raises(ValueError):
            E.apply(text, bad)
    with pytest.raises(ValueError):
        E.apply(text, [], expected="0")
    df = spark.createDataFrame([("f", text), ("g", text)], "file_path string, text string")
    new, undo = E.edit(df, "f", [E.Edit("replace", "X", 1, 1)], E.sha256(text))
    assert dict(new.collect()) == {"f": "X\nb\nc", "g": text}
    assert dict(E.revert(new, undo, "edit").collect()) == {"f": text, "g": text}
    assert tuple(E.read_lines(df, "f", 2, 3).first()) == ("f", "b\nc", 2, 3, 3, False)
    assert E.read_lines(df, "f", max_bytes=2).first().truncated
    s = spark.createDataFrame([("g", 2, 3, "Z")], "file_path string, line_start long, line_end long, new_source string")
    assert dict(E.edit_symbols(df, s).collect()) == {"f": text, "g": "a\nZ"}


def test_patterns(spark):
    source = "log(a, b)\nlog(x)\nother(log(1, 2, 3))\nif x == x:\n    pass\n"
    assert [m["text"] for m in X.matches(source, "log($A, $$$REST)")] == ["log(a, b)", "log(x)", "log(1, 2, 3)"]
    assert [m["captures"] for m in X.matches(source, "$X == $X")] == [{"X": "x"}]
    assert X.matches("a == b", "$X == $X") == [] and X.matches("def (", "$X") == []
    assert X.rewrite(source, "log($A, $$$REST)", "trace($$$REST, $A)")[0].startswith("trace(b, a)\n")
    df = spark.createDataFrame([("a.py", "python", source), ("b.js", "javascript", source)], "file_path string, language string, text string")
    assert X.search(df, "log($$$)").count() == 3 and [r.replaced for r in X.rewrite_files(df, "log($X)", "$X").collect()] == [3]


def test_composition(spark, files, symbols):
    assert C.route("where is `Store.connect` defined").symbol == "Store.connect" and C.route("getUserById").mode == "symbol"
    assert C.route("how do we store things", text_hits=lambda q: 5).mode == "text" and C.route("who imports this").mode == "semantic"
    assert C.route("how is the payload copied through every vector index collection before filters run").mode == "bundle"
    assert C.route("anything else", has_vectors=False).mode == "text"
    rows = spark.createDataFrame([(0, "a", 1), (0, "a", 2), (0, "b", 3), (0, "c", 4)], "query_id int, file_path string, rank int")
    assert {(r.file_path, r.part) for r in C.split_anchors(rows, 1, 1).collect()} == {("a", "anchor"), ("b", "neighbour")}
    expected = spark.createDataFrame([(0, "b"), (1, "z")], "query_id int, fragment string")
    m = C.retrieval_metrics(rows, expected).first()
    assert (m.queries, m.hit_at_1, m.hit_at_3, round(m.mrr, 6)) == (2, 0.0, 0.5, round(1 / 6, 6))
    edges = G.import_edges(files)
    chosen, related = C.bundle(spark.createDataFrame([(0, "app/main.py", 1), (0, "x.json", 2)], "query_id int, file_path string, rank int"), edges, "helper util", anchors=1)
    assert [r.file_path for r in chosen.collect()] == ["app/main.py"] and [r.file_path for r in related.collect()] == ["x.json", "pkg/util.py"]
    assert [r.relation for r in C.module_local(files, "web/a.ts", []).collect()] == ["parent_directory", "parent_directory", "same_directory"]
    assert [r.name for r in C.helpers(symbols, "pkg/util.py", "_quiet").collect()] == ["helper"]
    assert C.prioritise(symbols, "Store").first().name == "Store"
    hits = spark.createDataFrame([("docs/a.md", 3.0), ("src/b.py", 2.0)], "path string, score double")
    assert {(r.path, r.part) for r in C.split_text(hits, "question", 5).collect()} == {("docs/a.md", "related"), ("src/b.py", "seed")}
    assert [r.file_path for r in C.lexical_related(hits, rows, "question").collect()] == ["src/b.py"]
    assert C.focus(files, "app/main.py", ["helper", "path"]).first().line_start == 12


def test_focus_on_what_the_question_is_about(spark):
    text = "\n".join(["load it", "x", "x", "x", "x", "start of orders", "", "", "", "load shop", "", "", "", "", "name_of orders"])
    files = spark.createDataFrame([("a.js", text)], "file_path string, text string")
    one = lambda words, **o: tuple(C.focus(files, "a.js", words, **o).select("line_start", "line_end", "score").first())
    assert one(["start", "orders"]) == (4, 8, pytest.approx(0.05 * (6 + 2)))
    assert one(["load", "orders"], score=1.0)[:2] == (4, 8)  # a line with words of DOING alone counts a quarter
    assert one(["orders"], score=1.0) == (4, 8, pytest.approx(1.0 + 0.05 * 4))
    assert one(["shop", "carts"], project="shop", score=1.0)[2] == pytest.approx(0.55 * 0.55 + 0.05 * 4)
    assert C.focus(files, "a.js", ["nothing"]).collect() == [] and C.focus(files, "a.js", []).collect() == []


def test_companions(spark):
    row = "file_path string, relation string, seed_file string, distance int, score double"
    lexical = spark.createDataFrame([("a", "lexical", "", 1, 3.0), ("b", "lexical", "", 1, 2.0)], row)
    graph = spark.createDataFrame([("g", "graph", "", 1, 1.0), ("b", "graph", "", 1, 0.5), ("h", "graph", "", 1, 0.2)], row)
    assert [r.file_path for r in C.interleave(lexical, graph, 9).collect()] == ["g", "a", "b", "h"]
    found = spark.createDataFrame([("scripts/x.py", 1), ("src/y.py", 2), ("a/scripts/z.py", 3)], "file_path string, rank int")
    assert [r.file_path for r in C.tooling_neighbours(found, found.where("rank = 1"), "benchmark latency", 5).collect()] == ["a/scripts/z.py"]
    assert C.tooling_neighbours(found, found.limit(0), "how are orders stored", 5).collect() == []
    assert C.text_is_primary([("a", ["one", "two", "three", "four"])], "q", set()) and not C.text_is_primary([("a", ["one", "two", "three", "four"])], "q", {"a"})
    assert C.text_is_primary([("a", ["order", "cart", "price"])], "order cart price rules", set()) and not C.text_is_primary([("a", ["order"])], "order cart", set())
    hits = spark.createDataFrame([("d/x.py", 2.0, 1, 4, "body", "python", True)] * 2, "path string, score double, line_start int, line_end int, snippet string, language string, truncated boolean")
    assert [(r.file_path, r.symbol_name, r.symbol_kind, r.source, r.path_context) for r in C.text_results(hits).collect()] == [("d/x.py", "x.py", "file_match", "body", "d/x.py")]


@pytest.mark.parametrize(
    ("lines", "kept"),
    [
        (["*.log", "!keep.log"], {"a.py", "keep.log", "d/keep.log"}),
        (["/d", "!d/keep.log"], {"a.py", "x.log", "keep.log"}),  # nothing inside an ignored folder comes back
        (["d/*.log"], {"a.py", "x.log", "keep.log"}),
        (["**/keep.log", "# x.log", ""], {"a.py", "x.log", "d/x.log"}),
        (["d/"], {"a.py", "x.log", "keep.log"}),
        (["a.py/"], {"a.py", "x.log", "keep.log", "d/x.log", "d/keep.log"}),
        (["[xk]*.log"], {"a.py"}),
        (["?.log", "d/**"], {"a.py", "keep.log"}),
    ],
)
def test_ignore_rules(spark, lines, kept):
    rows = spark.createDataFrame([(p,) for p in ("a.py", "x.log", "keep.log", "d/x.log", "d/keep.log")], "p string")
    assert {r.p for r in rows.where(~L.ignored(F.col("p"), L.ignore_rules(lines))).collect()} == kept


def test_ignore_files_are_read(spark, tmp_path):
    for name in ("src/gen/a.py", "src/b.py", "lib/gen/c.py", "lib/d.go"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".gitignore").write_text("gen/\n*.go\n")
    (tmp_path / "lib/.gitignore").write_text("!d.go\n")
    assert {r.file_path for r in L.scan(spark, str(tmp_path), content=False).collect()} == {"src/b.py", "lib/d.go"}
    (tmp_path / "package.json").write_text("{}")
    assert L.project_name(str(tmp_path / "src" / "gen")) == L.project_name(str(tmp_path)) and L.project_name("x", "9 lives!") == "_9_lives_"


def test_manifest_moves_all_together(spark, tmp_path):
    store = str(tmp_path / "store")
    m, data = Manifest(spark, store), {n: Snapshots(spark, f"{store}/{n}") for n in "ab"}
    assert m.read() == {}
    for i in range(4):
        m.write({n: d.write(spark.range(i + 1)) for n, d in data.items()})
        assert m.read() == {"a": i + 1, "b": i + 1}
    assert data["a"].versions() == [3, 4] and data["a"].read(m.read()["a"]).count() == 4  # the state before stays readable
    data["a"].commit(4)
    assert [(c["name"], c["current"]) for c in collections(spark, store)] == [("a", 4)]


def test_operations():
    ops, gate = feed.Operations(most=2), threading.Event()
    one, joined = ops.start("index", "/A", "p", lambda stage: stage("reading") or gate.wait(10) and {"files": 1})
    again, under_way = ops.start("index", "/a", "p", dict)
    assert not joined and under_way and again is one and [o.id for o in ops.listed(active=True)] == [one.id]
    gate.set()
    assert ops.wait(one.id, 10).status == "completed" and one.result == {"files": 1}
    bad, _ = ops.start("index", "/a", "p", lambda stage: 1 / 0)
    assert ops.wait(bad.id, 10).status == "failed" and "zero" in bad.error


def test_pack_lines(spark):
    rows = spark.createDataFrame([("a", 1, "one two three four five six seven eight nine"), ("a", 2, "x"), ("b", 1, "y")], "file_path string, line_number int, line string")
    assert [(r.file_path, r.line_number) for r in K.pack_lines(rows, 12).orderBy("file_path", "line_number").collect()] == [("a", 2), ("b", 1)]


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, text in (("a/x.py", "print(1)"), ("a/y.txt", "no"), ("node_modules/z.js", "1"), (".hidden.py", "1"), ("bin.py", "a\x00b"), ("skip_me.go", "package x")):
        (tmp_path / name).write_text(text)
    found = L.texts(L.scan(spark, str(tmp_path), ignore=["skip_*"]))
    assert [(r.file_path, r.language, r.text) for r in found.collect()] == [("a/x.py", "python", "print(1)")]
    assert [r.folder for r in L.folders(found).collect()] == ["a"] and L.project_name("/x/My Project/") == "My_Project"


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "points"))
    rows = lambda *x: spark.createDataFrame(list(x), "chunk_id string, file_path string, file_hash string")
    assert s.current() is None and s.versions() == []
    s.upsert(rows(("1", "a", "h"), ("2", "b", "h")))
    s.upsert(rows(("2", "b", "h2"), ("3", "b", "h2")))
    assert s.current() == 2 and s.versions() == [2]
    assert {r.file_path: r.point_count for r in s.by_file().collect()} == {"a": 1, "b": 2}
    v = s.write(s.read())
    assert s.current() == 2 and s.commit(v) == [2]
    s.delete(F.col("file_path") == "b")
    assert [r.chunk_id for r in s.read().collect()] == ["1"] and s.info()["rows"] == 1
    assert fingerprint({"a": 1}) != fingerprint({"a": 2})


def test_streaming(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:00:02"), ("c", "2024-01-01 00:10:00"), ("z", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "path string, t string").select("path", F.to_timestamp("t").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    assert [r.paths for r in feed.debounced(df, "2 seconds").orderBy("start").collect()] == [["a", "b"], ["c"], ["z"]]
    feed.debounce_to_table(spark, str(tmp_path / "in"), "path string, ts timestamp", str(tmp_path / "out"), str(tmp_path / "ck"), "2 seconds").awaitTermination()
    assert [r.paths for r in spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()] == [["a", "b"], ["c"]]
    seen = []
    feed.refreshing(feed.changes(spark, str(tmp_path / "in"), "path string, ts timestamp"), lambda b, i: seen.append(b.count()), str(tmp_path / "ck2"), once=True).awaitTermination()
    assert sum(seen) == 5
    assert {r.path: r.ts.hour for r in feed.latest(df, "path").collect()}["a"] == 0
    assert sum(r.events for r in feed.windowed(df, "1 minute").collect()) == 5
