"""What users ask: routing of questions, bundles of anchors and their surroundings, merged companions, metrics."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import paths as P
from textquarry.functions import tokens as T
from textquarry.functions.intent import terms
from textquarry.operators import text_search as S

FLOW = frozenset("across through between without before after into carried carry copied copy generated route routed dependencies dependency importers callers cross".split())
STRUCTURE = frozenset("wrappers wrapper coverage client server latency benchmark context graph collection filters filter indexing indexed index vectors vector payloads payload prefix path reindex shadow".split())
COPYING, COPIED = frozenset("reindex shadow copied copy".split()), frozenset("points indexed index collection".split())
GRAPH = frozenset("import imports imported importers importer dependency dependencies depends callers caller calls called graph trace".split())


@dataclass(frozen=True)
class Route:
    mode: str  # symbol, text, bundle or semantic
    symbol: str | None = None


def symbol_score(name: str, question: str) -> int:
    """How much a word looks like an identifier that is meant."""
    score = 0
    if re.search(r"[a-z0-9][A-Z]|_", name):
        score += 5
    if re.search(r"::|\.|#", name):
        score += 5
    if f"`{name}`" in question:
        score += 5
    if question.strip() == name:
        score += 3
    if name[:1].isupper() and not question.strip().startswith(name):
        score += 2
    return score if len(name) >= 3 else 0


def symbol_candidate(question: str) -> str | None:
    """The likeliest identifier in a question, if it scores 5 or more."""
    words = [question.strip()] if re.fullmatch(r"[\w.:#]+", question.strip()) else []
    words += re.findall("`(.+?)`", question) + re.findall(r"[A-Za-z_](?:[\w.:#]*\w)?", question)
    cleaned = [w.strip("`.,?!()") for w in words]
    best = max(dict.fromkeys(cleaned), key=lambda w: symbol_score(w, question), default=None)
    return best if best and symbol_score(best, question) >= 5 else None


def wants_bundle(question: str) -> bool:
    """Broad questions over several files: six keywords or more, about a flow and two parts of the structure."""
    if S._about("tooling", terms(question)):
        return True
    words = set(T.keywords_py(question, 20))
    if len(words) < 6:
        return False
    if words & COPYING and words & COPIED:
        return True
    return bool(words & FLOW) and len(words & STRUCTURE) >= 2


def is_graph_question(question: str) -> bool:
    return bool(set(terms(question)) & GRAPH)


def graph_query(question: str) -> str:
    """A question about a graph put into the terms that code about it has."""
    asked, out = set(terms(question)), []
    for words, names in (({"import", "imports", "imported", "importers", "importer"}, "import module resolve"), ({"caller", "callers", "calls", "called"}, "caller callee call"), ({"dependency", "dependencies", "depends"}, "dependency import edge"), ({"trace", "graph"}, "graph node edge")):
        if asked & words:
            out += names.split()
    return " ".join(dict.fromkeys([*out, *T.keywords_py(question, 6)]))


def route(question: str, *, text_hits: Callable[[str], int] | None = None, has_vectors: bool = True) -> Route:
    """symbol if an identifier is meant; text if it isn't about a graph and text search finds four or more; a bundle for
    broad questions; else semantic search. Without vectors, text."""
    name = symbol_candidate(question)
    if name:
        return Route("symbol", name)
    if not is_graph_question(question) and text_hits and text_hits(question) >= 4:
        return Route("text")
    if not has_vectors:
        return Route("text")
    return Route("bundle" if wants_bundle(question) else "semantic")


def split_anchors(results: DataFrame, anchors: int, related: int, *, file: str = "file_path", by: str = "query_id", rank: str = "rank") -> DataFrame:
    """The best row of each file, with place and part: the first `anchors` files are anchors, the next `related` neighbours."""
    first = results.withColumn("_n", F.row_number().over(Window.partitionBy(by, file).orderBy(rank))).where("_n = 1").drop("_n")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(rank, file))).where(F.col("place") <= anchors + related)
    return placed.withColumn("part", F.when(F.col("place") <= anchors, "anchor").otherwise("neighbour"))


def merge_related(lists: list[DataFrame]) -> DataFrame:
    """(file_path, distance, relations, source_list) of frames (file_path, relation, seed_file, distance): the earlier
    list wins the place, relations come together, the least distance counts."""
    found = None
    for i, df in enumerate(lists):
        part = df.select("file_path", "relation", "seed_file", "distance", F.lit(i).alias("list"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("file_path").agg(F.min("distance").alias("distance"), F.array_sort(F.collect_set(F.struct("list", "relation", "seed_file"))).alias("relations"), F.min("list").alias("source_list"))


#: Words of questions about how something works, which the code that it calls explains.
BEHAVIOUR = frozenset("behavior flow fuse how logic merge why work works".split())


def wants_helpers(question: str) -> bool:
    return bool({w for w in re.findall(r"\w+", question.lower())} & BEHAVIOUR)


def import_related(edges: DataFrame, seeds: DataFrame, asked: list[str], limit: int = 8) -> DataFrame:
    """Import neighbours of the seeds (file_path), by shared words with the question, then path."""
    s = seeds.select(F.col("file_path").alias("seed_file"))
    out = edges.join(s, edges["source_file"] == s["seed_file"]).select("seed_file", F.col("target_file").alias("file_path"), F.lit("imports").alias("relation"))
    back = edges.join(s, edges["target_file"] == s["seed_file"]).select("seed_file", F.col("source_file").alias("file_path"), F.lit("imported_by").alias("relation"))
    q = F.array(*[F.lit(w) for w in asked]) if asked else F.array().cast("array<string>")
    both = out.unionByName(back).distinct().withColumn("score", F.size(F.array_intersect(T.path_tokens("file_path"), q))).withColumn("distance", F.lit(1))
    return both.orderBy(F.desc("score"), "file_path", "seed_file", "relation").limit(limit)


def module_local(files: DataFrame, seed: str, asked: list[str], limit: int = 6) -> DataFrame:
    """Files in the same folder, one below or one above, by shared words with the question."""
    folder = seed.rpartition("/")[0]
    above = folder.rpartition("/")[0]
    mine = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    relation = F.when(mine == folder, "same_directory").when(F.regexp_extract(mine, r"^(.*)/[^/]*$", 1) == folder, "child_directory").when(mine == above, "parent_directory")
    q = F.array(*[F.lit(w) for w in asked]) if asked else F.array().cast("array<string>")
    scored = files.where(F.col("file_path") != seed).select("file_path", relation.alias("relation"), F.size(F.array_intersect(T.path_tokens("file_path"), q)).alias("score")).where("relation IS NOT NULL")
    return scored.withColumn("seed_file", F.lit(seed)).withColumn("distance", F.lit(1)).orderBy(F.desc("score"), "relation", "file_path").limit(limit)


def skip_path(path: Column, question: str) -> Column:
    """Whether a path is left out: tools, documentation and tests, unless the question is about them."""
    asked = terms(question)
    out = F.lit(False)
    category = P.file_category(path)
    for topic, cond in (("documentation", category == "documentation"), ("test", category == "test"), ("tooling", S.tooling_penalty(path, []) < 1.0)):
        if not S._about(topic, asked):
            out = out | cond
    return out


def lexical_related(hits: DataFrame, taken: DataFrame, question: str, limit: int = 6) -> DataFrame:
    """Text hits (path, score) that aren't among the files taken, without skipped paths."""
    t = taken.select(F.col("file_path").alias("_t")).distinct()
    left = hits.join(t, hits["path"] == t["_t"], "left_anti").where(~skip_path(F.col("path"), question))
    return left.orderBy(F.desc("score"), "path").limit(limit).select(F.col("path").alias("file_path"), F.lit("lexical").alias("relation"), F.lit("").alias("seed_file"), F.lit(1).alias("distance"), "score")


def promote(primary: DataFrame, related: DataFrame, limit: int) -> DataFrame:
    """(file_path, score, list, place): one row a file from the primary results, filled up from the related ones."""
    both = primary.select("file_path", "score", F.lit(0).alias("list")).unionByName(related.select("file_path", "score", F.lit(1).alias("list")))
    once = both.withColumn("_n", F.row_number().over(Window.partitionBy("file_path").orderBy("list", F.desc("score")))).where("_n = 1").drop("_n")
    ordered = once.orderBy("list", F.desc("score"), "file_path").limit(limit)
    return ordered.withColumn("place", F.row_number().over(Window.orderBy("list", F.desc("score"), "file_path")))


def split_text(hits: DataFrame, question: str, limit: int) -> DataFrame:
    """(path, score, part): the seed is the first of the top five that isn't skipped (else the first); then distinct files."""
    ranked = hits.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "path")))
    flags = ranked.withColumn("bad", skip_path(F.col("path"), question) | (F.col("r") > 5))
    seed = F.min(F.struct("bad", "r")).over(Window.partitionBy())
    once = flags.withColumn("seed", seed["r"]).withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("r"))).where(f"n = 1 AND r <= {int(limit)}")
    return once.select("path", "score", F.when(F.col("r") == F.col("seed"), "seed").otherwise("related").alias("part"))


def helpers(symbols: DataFrame, file: str, name: str, limit: int = 6) -> DataFrame:
    """Callable symbols of the same file that the anchor's source mentions, by shared name tokens, then place."""
    here = symbols.where(F.col("file_path") == file)
    anchor = here.where(F.col("name") == name).select(F.col("source").alias("_src"), F.col("name").alias("_anchor")).limit(1)
    tokens_of = lambda c: T.symbol_tokens(c)
    rows = here.where((F.col("name") != name) & F.col("kind").isin("function", "method", "constructor", "class")).crossJoin(F.broadcast(anchor))
    used = rows.where(F.regexp(F.col("_src"), F.concat(F.lit(r"\b\Q"), F.col("name"), F.lit(r"\E\b"))))
    return used.withColumn("shared", F.size(F.array_intersect(tokens_of("name"), tokens_of("_anchor")))).orderBy(F.desc("shared"), "line_start", "name").limit(limit).drop("_src", "_anchor")


def prioritise(symbols: DataFrame, name: str) -> DataFrame:
    """By name, parent and kind; ties by line and path."""
    parent, _, bare = name.replace("::", ".").rpartition(".")
    score = F.when(F.lower("name") == bare.lower(), 6).otherwise(0) + F.when(F.col("kind").isin("function", "method", "constructor"), 2).otherwise(0) + F.when(F.col("kind").isin("class", "struct", "trait", "interface"), 3).otherwise(0)
    if parent:
        score = score + F.when(F.lower("parent") == parent.lower(), 4).when(F.lower(F.coalesce("parent", F.lit(""))).contains(parent.lower()), 1).otherwise(0)
    return symbols.withColumn("priority", score).orderBy(F.desc("priority"), "line_start", "file_path")


def merge_symbols(lists: list[DataFrame], keys: tuple[str, ...] = ("file_path", "name", "kind", "line_start", "line_end")) -> DataFrame:
    """The lists one after the other, each symbol once, from the earliest."""
    found = None
    for i, df in enumerate(lists):
        part = df.select(*keys).withColumn("list", F.lit(i))
        found = part if found is None else found.unionByName(part)
    return found.groupBy(*keys).agg(F.min("list").alias("list"))


def text_is_primary(hits: list[tuple[str, list[str]]], question: str, skipped: set[str]) -> bool:
    """Whether text hits (path, matched terms; best first) answer by themselves: one of the first five that isn't skipped
    matches four terms, or three keywords of the question."""
    asked = set(T.keywords_py(question, 20))
    return any(len(m) >= 4 or len(asked & {t.lower() for t in m}) >= 3 for path, m in hits[:5] if path not in skipped)


def text_results(hits: DataFrame) -> DataFrame:
    """Text hits as results: the snippet of a file with its place, each place once."""
    once = hits.dropDuplicates(["path", "line_start", "line_end"])
    return once.select(F.col("path").alias("file_path"), F.substring_index("path", "/", -1).alias("symbol_name"), F.lit("file_match").alias("symbol_kind"), "line_start", "line_end", F.col("snippet").alias("source"), F.col("snippet").alias("description"), "language", T.path_context("path").alias("path_context"), "score")


def tooling_neighbours(results: DataFrame, taken: DataFrame, question: str, limit: int) -> DataFrame:
    """Of semantic results (file_path, rank) the scripts that aren't taken; only for questions about tools."""
    out = results if S._about("tooling", terms(question)) else results.limit(0)
    scripts = out.where(P.normal_path(F.col("file_path")).rlike(r"(^|/)scripts/")).join(taken.select("file_path").distinct(), "file_path", "left_anti")
    first = scripts.groupBy("file_path").agg(F.min("rank").alias("rank")).orderBy("rank", "file_path").limit(limit)
    return first.select("file_path", F.lit("semantic_tooling_neighbor").alias("relation"), F.lit("").alias("seed_file"), F.lit(1).alias("distance"))


def wants_companions(question: str) -> bool:
    """Whether a second search, in the terms of graph code, adds to an answer."""
    return is_graph_question(question)


def interleave(lexical: DataFrame, graph: DataFrame, limit: int) -> DataFrame:
    """The best graph companion first, then the lexical ones, then the other graph ones; each file once.

    Both: (file_path, relation, seed_file, distance, score).
    """
    ranked = graph.withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), "file_path")))
    both = lexical.withColumn("list", F.lit(1)).unionByName(ranked.withColumn("list", F.when(F.col("n") == 1, 0).otherwise(2)).drop("n"))
    once = both.withColumn("n", F.row_number().over(Window.partitionBy("file_path").orderBy("list", F.desc("score")))).where("n = 1").drop("n")
    return once.orderBy("list", F.desc("score"), "file_path").limit(limit)


#: Words that say that something is done, not what with.
DOING = frozenset("begin init load open run show start".split())
STRUCTURED = r"""[a-z0-9]+_[a-z0-9_]+|typename|name:\s*"[^"]+\""""


def focus(files: DataFrame, file: str, words: list[str], *, around: int = 2, project: str = "", score: float = 0.0) -> DataFrame:
    """(file_path, line_start, line_end, score, snippet): the place of one file that answers best.

    Lines that hold one of the first four words are rated with the lines about them: 3 for each word in the line, 1 for
    each word in the block; a quarter of that if the line only has words of DOING and the block none of the subject's.
    The result's own score counts less if the line only has words of the project's name, or the block has neither a
    word of the subject nor structure; a twentieth of the rating is added.
    """
    used, asked = words[:4], list(dict.fromkeys(w.lower() for w in words))
    own = {t for t in T.symbol_tokens_py(project) if len(t) >= 4}
    subject = [w for w in asked if w not in DOING and w not in own]
    lines = S.lines(files.where(F.col("file_path") == file), key="file_path")
    near = Window.partitionBy("file_path").orderBy("line_number").rowsBetween(-around, around)
    block = lines.withColumn("block", F.array_join(F.collect_list("line").over(near), "\n")).withColumn("line_start", F.min("line_number").over(near)).withColumn("line_end", F.max("line_number").over(near))
    low = F.lower("block")
    holds = lambda text, ws: [F.when(text.contains(w), w) for w in ws]
    held = F.array_compact(F.array(*holds(F.col("line"), used))) if used else F.array().cast("array<string>")
    within = lambda ws: F.forall(held, lambda t: t.isin(*sorted(ws))) if ws else F.lit(False)
    told = F.lit(bool(subject)) & ~sum((low.contains(w).cast("int") for w in subject), F.lit(0)).cast("boolean")
    rated = block.withColumn("held", held).where(F.size("held") > 0).withColumn("rating", (F.size("held") * 3.0 + sum((low.contains(w).cast("int") for w in asked), F.lit(0))) * F.when(within(DOING) & told, 0.25).otherwise(1.0))
    factor = F.when(within(own) & told, 0.55).otherwise(1.0) * F.when(told & ~low.rlike(STRUCTURED), 0.55).otherwise(1.0)
    best = rated.orderBy(F.desc("rating"), "line_number").limit(1)
    return best.select("file_path", "line_start", "line_end", (F.lit(float(score)) * factor + F.col("rating") * 0.05).alias("score"), F.col("block").alias("snippet"))


def retrieval_metrics(results: DataFrame, expected: DataFrame, *, by: str = "query_id", path: str = "file_path", rank: str = "rank") -> DataFrame:
    """One row: queries, hit_at_1, hit_at_3, mrr, coverage (of expected fragments among the first three).

    expected: (query_id, fragment). A result is right if its path contains a fragment of its query.
    """
    e = expected.select(F.col(by).alias("q"), "fragment").distinct()
    total = e.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    hit = results.join(e, (F.col(by) == F.col("q")) & F.col(path).contains(F.col("fragment")))
    per = hit.groupBy("q").agg(F.min(rank).alias("first"), F.countDistinct(F.when(F.col(rank) <= 3, F.col("fragment"))).alias("covered"))
    each = total.join(per, "q", "left")
    flag = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    return each.agg(F.count(F.lit(1)).alias("queries"), flag(1).alias("hit_at_1"), flag(3).alias("hit_at_3"), F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce(F.col("covered"), F.lit(0)) / F.col("n")).alias("coverage"))


def bundle(results: DataFrame, edges: DataFrame, question: str, *, anchors: int = 3, related: int = 8, seeds: int = 1) -> tuple[DataFrame, DataFrame]:
    """Anchors of one query's ranked results, and merged companions: tools where they are asked about, semantic neighbours,
    then import neighbours of the first `seeds` anchors."""
    split = split_anchors(results, anchors, related)
    chosen = split.where("part = 'anchor'")
    near = split.where("part = 'neighbour'").select("file_path", F.lit("semantic_neighbor").alias("relation"), F.lit("").alias("seed_file"), F.lit(1).alias("distance"))
    tools = tooling_neighbours(results, chosen, question, related)
    imports = import_related(edges, chosen.orderBy("place").limit(max(seeds, 1)), T.keywords_py(question), related).select("file_path", "relation", "seed_file", "distance")
    merged = merge_related([tools, near, imports]).join(chosen.select("file_path"), "file_path", "left_anti")
    return chosen, merged.orderBy("source_list", "distance", "file_path").limit(related)


def instructions(project: str, points: int) -> str:
    """Guidance for a caller, by whether there is an index."""
    if not points:
        return f"{project}: nothing is indexed yet; use text search and symbol lookup, or index the folder first."
    return f"{project}: {points:,} points. Ask for symbols by name, for passages by text search, and broad questions by the bundle."
