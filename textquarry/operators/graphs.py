"""Import and call graphs: parsing, resolution, neighbours, callers, breadth-first traces, cycles, degrees."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators.text_index import parts
from textquarry.sources.snapshots import scratch

#: Of sharing(): links and pairs of pages in one task, and links of pages asked for that are broadcast in one pass.
LINKS, PAIRS, ASKED = 1_000_000, 1_000_000, 200_000

QUOTED = r"""["'`]([^"'`]+)["'`]"""


def parse_import(statement: Column, language: Column) -> Column:
    """The module that an import statement names; empty where none is recognised."""
    s = F.trim(statement)
    python = F.when(s.rlike(r"^from\s"), F.trim(F.regexp_extract(s, r"^from\s+(.*?)\s*\bimport\b", 1))).otherwise(F.regexp_extract(s, r"^import\s+([^,\s]+)", 1))
    js = F.coalesce(F.nullif(F.regexp_extract(s, r"from\s*" + QUOTED, 1), F.lit("")), F.nullif(F.regexp_extract(s, r"require\(\s*" + QUOTED, 1), F.lit("")), F.regexp_extract(s, r"^import\s*" + QUOTED, 1))
    tail = lambda word: F.trim(F.regexp_replace(F.regexp_extract(s, rf"(?s)^{word}\s+(?:static\s+)?(.*)$", 1), ";+$", ""))
    using = tail("using")
    return (
        F.when(language == "python", python)
        .when(language.isin("javascript", "typescript", "tsx"), js)
        .when(language == "rust", F.trim(F.substring_index(tail("use"), "::", 1)))
        .when(language == "go", F.regexp_extract(s, r"(?s)^import\s*\(?\s*" + QUOTED, 1))
        .when(language == "java", tail("import"))
        .when(language == "csharp", F.when(using.contains("="), F.trim(F.regexp_extract(using, "=(.*)$", 1))).otherwise(using))
        .when(language.isin("c", "cpp"), F.regexp_extract(s, r"""^#include\s*[<"]([^>"]+)[>"]""", 1))
        .otherwise(F.lit(""))
    )


def import_statements(files: DataFrame) -> DataFrame:
    """(source_file, language, line, statement) of lines that import."""
    rows = files.select(F.col("file_path").alias("source_file"), "language", F.posexplode(F.split("text", "\r?\n")).alias("i", "statement"))
    shape = F.when(F.col("language") == "python", r"^\s*(from\s+\S+\s+import\b|import\s+\S)").when(F.col("language").isin("javascript", "typescript", "tsx"), r"(^\s*(import|export)\b.*['\"]|\brequire\()").when(F.col("language") == "rust", r"^\s*(pub\s+)?use\s").when(F.col("language").isin("go", "java"), r"^\s*import\b").when(F.col("language") == "csharp", r"^\s*using\s").when(F.col("language").isin("c", "cpp"), r"^\s*#include\b")
    return rows.where(F.regexp(F.col("statement"), shape)).select("source_file", "language", (F.col("i") + 1).cast("long").alias("line"), F.trim(F.regexp_replace("statement", r"^\s*pub\s+", "")).alias("statement"))


def _normal(path: Column) -> Column:
    """Resolves . and .. parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return F.array_join(walked, "/")


def candidates(module: Column, language: Column, source: Column) -> Column:
    """Paths that an import may mean, the likeliest first."""
    folder = F.regexp_extract(source, r"^(.*)/[^/]*$", 1)
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))
    base = F.when(dots > 0, F.concat(folder, F.lit("/"), up, rest)).otherwise(rest)
    above = F.regexp_extract(base, r"^(.*)/[^/]*$", 1)
    py = lambda b: F.array(F.concat(b, F.lit(".py")), F.concat(b, F.lit("/__init__.py")), F.concat(b, F.lit(".pyi")))
    python = F.when((dots == 0) & (above != ""), F.concat(py(base), py(above))).otherwise(py(base))
    target = F.concat(folder, F.lit("/"), module)
    bare = F.regexp_replace(target, r"\.[^./]*$", "")
    js = F.when(module.rlike("^[./]"), F.concat(F.array(target), F.transform(F.array(*[F.lit(x) for x in ("ts", "tsx", "js", "jsx", "mjs", "cjs")]), lambda e: F.concat(bare, F.lit("."), e)), F.transform(F.array(*[F.lit(x) for x in ("ts", "tsx", "js", "jsx")]), lambda e: F.concat(target, F.lit("/index."), e)))).otherwise(F.array().cast("array<string>"))
    rust = F.when(module.isin("crate", "self", "super"), F.array(F.lit("src/lib.rs"), F.lit("src/main.rs"))).otherwise(F.array().cast("array<string>"))
    c = F.array(F.concat(folder, F.lit("/"), module), module)
    found = F.when(language == "python", python).when(language.isin("javascript", "typescript", "tsx"), js).when(language == "rust", rust).when(language.isin("c", "cpp"), c).otherwise(F.array().cast("array<string>"))
    return F.transform(found, _normal)


def import_edges(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(source_file, target_file, import_statement, module_path, language, line): imports that lead to another file.

    known: all files, if `files` are only those to parse. Candidate paths are joined with the paths by equality; of those that exist the likeliest wins. Edges of a file to
    itself go, repeated ones stay.
    """
    found = import_statements(files).withColumn("module_path", parse_import(F.col("statement"), F.col("language"))).where("module_path != ''")
    spread = found.select("*", F.posexplode(candidates(F.col("module_path"), F.col("language"), F.col("source_file"))).alias("p", "target_file"))
    real = spread.join((files if known is None else known).select(F.col("file_path").alias("target_file")), "target_file")
    best = real.groupBy("source_file", "language", "line", "statement", "module_path").agg(F.min_by("target_file", "p").alias("target_file"))
    return best.where("source_file != target_file").select("source_file", "target_file", F.col("statement").alias("import_statement"), "module_path", "language", "line")


def neighbours(edges: DataFrame, file: str) -> DataFrame:
    """(relation, other_file, ...) outgoing and incoming edges of one file."""
    out = edges.where(F.col("source_file") == file).select(F.lit("imports").alias("relation"), F.col("target_file").alias("other_file"), "module_path", "line")
    return out.unionByName(edges.where(F.col("target_file") == file).select(F.lit("imported_by").alias("relation"), F.col("source_file").alias("other_file"), "module_path", "line"))


def links(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, href) of the links of pages."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))


def sharing(links: DataFrame, asked: DataFrame, *, least: int, key: str = "page_id", target: str = "href") -> DataFrame:
    """(key, other_id, shared): of each page asked for, the others that share `least` targets or more with it.

    links, asked: (key, target), asked a part of links. Pages asked for are broadcast, at most about ASKED of their links in
    one pass, to the links of all pages, which lie by page: so a pair is counted where its other page is, and no pairs are
    shuffled. The pairs are counted by target first, and the pages go to so many tasks that about PAIRS are in one; what is
    counted is their number by nature, the links asked for times the links of the same targets.
    """
    n = parts(links, links.count(), LINKS)
    each = lambda df, out: df.select(key, target).repartition(n, key).distinct().groupBy(target).agg(F.count(F.lit(1)).alias(out))
    few = each(asked, "a")
    rows, pairs = few.join(each(links, "b"), target).agg(F.sum("a"), F.sum(F.col("a").cast("double") * F.col("b"))).first()
    passes = max(1, -(-(rows or 0) // ASKED))
    n = max(n, parts(links, int(pairs or 0) // passes, PAIRS))
    other = links.select(F.col(key).alias("other_id"), target).repartition(n, "other_id").distinct()
    found = None
    for no in range(passes):
        own = asked.select(key, target).where(F.pmod(F.xxhash64(key), F.lit(passes)) == no).distinct()
        part = other.join(F.broadcast(own), target).where(F.col(key) != F.col("other_id")).groupBy(key, "other_id").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
        found = part if found is None else found.unionByName(part)
    return found


def call_sites(symbols: DataFrame) -> DataFrame:
    """(caller_symbol_id, callee_name, callee_name_lower, caller_line): names before parentheses in callable symbols.

    Ids are those of the whole table, so callers are right in every file.
    """
    body = symbols.where(F.col("kind").isin("function", "method", "constructor")).select("symbol_id", "line_start", "name", F.posexplode(F.split("source", "\n")).alias("i", "line"))
    calls = body.select("symbol_id", "line_start", "i", F.explode(F.regexp_extract_all("line", F.lit(r"(?<![\w.])(?:\w+\.)*(\w+)\s*\("), F.lit(1))).alias("callee_name"), "name")
    words = ("if", "for", "while", "switch", "return", "def", "fn", "func", "function", "class", "match", "catch", "elif", "not", "and", "or", "in", "print")
    real = calls.where(~F.col("callee_name").isin(*words) & ~((F.col("i") == 0) & (F.col("callee_name") == F.col("name"))))
    return real.select(F.col("symbol_id").alias("caller_symbol_id"), "callee_name", F.lower("callee_name").alias("callee_name_lower"), (F.col("line_start") + F.col("i")).alias("caller_line"))


def callers(symbols: DataFrame, sites: DataFrame, name: str, limit: int = 100) -> DataFrame:
    hit = sites.where(F.col("callee_name_lower") == name.lower())
    who = symbols.select(F.col("symbol_id").alias("caller_symbol_id"), F.col("name").alias("caller"), "file_path")
    return hit.join(who, "caller_symbol_id").orderBy("file_path", "caller_line", "caller").select("file_path", "caller", "caller_line", "callee_name").limit(limit)


def call_edges(symbols: DataFrame, sites: DataFrame) -> DataFrame:
    """(src, dst): caller and callee ids, by name."""
    named = symbols.where(F.col("kind") != "import").select(F.col("symbol_id").alias("dst"), F.lower("name").alias("callee_name_lower"))
    return sites.join(named, "callee_name_lower").select(F.col("caller_symbol_id").alias("src"), "dst").distinct()


def degrees(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, fan_in, fan_out) of distinct edges: one shuffle on the node."""
    ends = edges.select(src, dst).distinct().select(F.explode(F.array(F.struct(F.col(src).alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col(dst).alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def trace(spark: SparkSession, edges: DataFrame, start: DataFrame, *, depth: int = 5, direction: str = "downstream") -> DataFrame:
    """(node, level): least number of steps from the start nodes, up to `depth`.

    One join a level against the edges, without what was visited; each level is a written table (in the folder named by
    spark.checkpoint.dir), so lineage stays short and a lost executor costs only its own tasks.
    """
    ways = {"downstream": [("src", "dst")], "upstream": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
    path = f"{scratch(spark)}/trace-{uuid.uuid4().hex}"
    step = None
    for a, b in ways:
        part = edges.select(F.col(a).alias("node"), F.col(b).alias("next"))
        step = part if step is None else step.unionByName(part)
    step.distinct().write.parquet(f"{path}/edges")  # read at every level
    step = spark.read.parquet(f"{path}/edges")
    start.select("node").distinct().withColumn("level", F.lit(0)).write.parquet(f"{path}/level=0")
    read = lambda n: spark.read.parquet(*[f"{path}/level={i}" for i in range(n + 1)])
    done = 0
    for level in range(1, depth + 1):
        seen = read(level - 1)
        front = spark.read.parquet(f"{path}/level={level - 1}")
        new = front.join(step, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        new.withColumn("level", F.lit(level)).write.parquet(f"{path}/level={level}")
        if not spark.read.parquet(f"{path}/level={level}").take(1):
            break
        done = level
    return read(done).select("node", "level")


def trace_edges(edges: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """Edges that leave a node reached before the last level, with that level; also to nodes visited before."""
    at = nodes.where(F.col("level") < depth).select(F.col("node").alias("src"), "level")
    return edges.select("src", "dst").distinct().join(at, "src")


def cycles(edges: DataFrame, most: int = 4) -> DataFrame:
    """(length, nodes): simple directed cycles of up to `most` nodes, each once, beginning with its least node."""
    e = edges.select("src", "dst").distinct()
    paths = e.where("src <= dst").select(F.array("src", "dst").alias("p"))
    found = paths.where(F.col("p")[0] == F.col("p")[1]).select(F.lit(1).alias("length"), F.slice("p", 1, 1).alias("nodes"))
    paths = paths.where(F.col("p")[0] != F.col("p")[1])
    for n in range(2, most + 1):
        grown = paths.join(e, F.element_at("p", -1) == F.col("src")).where((F.col("dst") == F.col("p")[0]) | (~F.array_contains("p", F.col("dst")) & (F.col("dst") > F.col("p")[0])))
        found = found.unionByName(grown.where(F.col("dst") == F.col("p")[0]).select(F.lit(n).alias("length"), F.col("p").alias("nodes")))
        if n < most:
            paths = grown.where(F.col("dst") != F.col("p")[0]).select(F.concat("p", F.array("dst")).alias("p"))
    return found
