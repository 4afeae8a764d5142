"""One folder of sources, indexed in versioned tables, and the questions that can be asked of it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from textquarry.functions import tokens as T
from textquarry.operators import compose as C
from textquarry.operators import edits as E
from textquarry.operators import graphs as G
from textquarry.operators import hygiene as H
from textquarry.operators import incremental as N
from textquarry.operators import packing as K
from textquarry.operators import patterns as X
from textquarry.operators import protocol as R
from textquarry.operators import rescoring as B
from textquarry.operators import symbols as Y
from textquarry.operators import text_index as I
from textquarry.operators import text_search as S
from textquarry.operators import vector_search as V
from textquarry.sources import files as L
from textquarry.sources.snapshots import Manifest, Snapshots, fingerprint, scratch
from textquarry.streaming import feed

DIMENSIONS = 256
TABLES = ("files", "symbols", "points", "docs", "postings", "path_postings", "imports", "calls")


def hashed_vector(text: str, dimensions: int = DIMENSIONS) -> list[float]:
    """A deterministic vector of a text: its tokens hashed with signs, normalised. Stands in where no model is given."""
    import zlib

    v = np.zeros(dimensions, np.float32)
    for t in T.query_tokens(text):
        h = zlib.crc32(t.encode())
        v[h % dimensions] += 1.0 if h & 0x80000000 else -1.0
    size = float(np.linalg.norm(v))
    return (v / size if size else v).tolist()


@F.pandas_udf(ArrayType(FloatType()))
def hashed_vectors(texts: pd.Series) -> pd.Series:
    return texts.fillna("").map(hashed_vector)


class Context(NamedTuple):
    """An answer: how it was found, its results, files beside them, and callers of the first result."""

    mode: str
    results: DataFrame
    related: DataFrame | None = None
    callers: DataFrame | None = None


class Project:
    """rules: rescoring terms for the project's own files. root: the folder; store: where its tables are kept. embed: a column function text -> vector and one for query
    strings; by default hashed tokens. fast: fewer and larger chunks, no descriptions."""

    def __init__(self, spark: SparkSession, root: str, store: str, *, embed: Callable[[Column], Column] = hashed_vectors, embed_query: Callable[[str], list[float]] = hashed_vector, fast: bool = False, ignore: list[str] | None = None, rules: Sequence[B.Rule] = ()):
        self.rules = rules
        self.spark, self.root, self.embed, self.embed_query, self.fast, self.ignore = spark, root, embed, embed_query, fast, ignore
        self.name = L.project_name(root)
        self.store = f"{store.rstrip('/')}/{self.name}-{fingerprint({'fast': fast, 'embed': getattr(embed, '__name__', 'custom')})}"
        self._tables = {t: Snapshots(spark, f"{self.store}/{t}") for t in TABLES}
        self._manifest = Manifest(spark, self.store)

    def _current(self, name: str) -> int | None:
        return self._manifest.read().get(name)

    def table(self, name: str) -> DataFrame:
        """A table as the manifest names it: those of one state belong together."""
        return self._tables[name].read(self._current(name))

    def _read(self, content: bool = True) -> DataFrame:
        return L.scan(self.spark, self.root, ignore=self.ignore, content=content)

    # building

    def _chunks(self, files: DataFrame, symbols: DataFrame) -> DataFrame:
        """Symbols as chunks, and files without symbols cut at good places."""
        hashes = files.select("file_path", "file_hash")
        if self.fast:  # large bundles are kept as pieces, not by their symbols
            bundles = files.where(H.artifact_downgrade(F.col("text"), F.col("file_path"), F.col("language"))).select("file_path")
            symbols = symbols.join(bundles, "file_path", "left_anti")
        own = symbols.where(~F.col("kind").isin("import", "data_key")).join(hashes, "file_path").select("file_path", "language", F.col("name").alias("symbol_name"), F.col("kind").alias("symbol_kind"), "line_start", "line_end", "byte_start", "byte_end", "source", "signature", "docstring", "parent", "visibility", "role", "file_hash")
        bare = files.join(symbols.select("file_path").distinct(), "file_path", "left_anti")
        parts = K.chunk_files(bare).join(hashes, "file_path")
        text = lambda: F.lit(None).cast("string")
        whole = parts.select("file_path", "language", F.concat(F.lit("part_"), "no").alias("symbol_name"), F.when(H.artifact_bundle("file_path"), "file_artifact").otherwise("file").alias("symbol_kind"), "line_start", "line_end", F.col("start").alias("byte_start"), F.col("end").alias("byte_end"), "source", text().alias("signature"), text().alias("docstring"), text().alias("parent"), text().alias("visibility"), text().alias("role"), "file_hash")
        both = own.unionByName(whole).withColumn("source", H.truncated(F.col("source")))
        named = both.withColumn("chunk_id", H.chunk_id(both))
        kept = H.filter_chunks(named, min_bytes=200 if self.fast else 1, per_file=H.PER_FILE if self.fast else 400)
        return H.global_cap(kept, H.TOTAL) if self.fast else kept

    def _points(self, chunks: DataFrame) -> DataFrame:
        """Vectors are made once for chunks of equal content and context, and given to all of them."""
        unique = H.dedup(chunks).where("is_representative")
        shown = F.lit("") if self.fast else H.description(unique)
        made = unique.select("dedup_hash", shown.alias("description"), H.description_keywords(unique).alias("keywords"), self.embed(F.concat_ws(" ", "symbol_name", "source")).alias("code"), self.embed(F.concat_ws(" ", shown, "symbol_name")).alias("description_vec"))
        expanded = H.dedup_expand(chunks, made)
        return expanded.withColumn("path_context", T.path_context("file_path")).withColumn("path_prefixes", T.path_prefixes("file_path"))

    def _made(self, files: DataFrame) -> dict[str, DataFrame]:
        symbols = Y.extract(files).withColumn("symbol_id", F.xxhash64("file_path", "name", "kind", "byte_start"))
        index = I.build(files.select(F.xxhash64("file_path").alias("doc"), F.col("file_path").alias("path"), "language", "text"))
        docs = files.select(F.xxhash64("file_path").alias("doc"), F.col("file_path").alias("path"), "language")
        return {"files": files, "symbols": symbols, "docs": docs, "postings": index.postings, "path_postings": index.path_postings}

    def index(self) -> dict:
        """Builds all tables anew and makes them current together; returns info()."""
        self._commit(self._made(L.texts(self._read())), None)
        return self.info()

    def refresh(self) -> dict:
        """Reads what changed since: files whose time or size differ, then whose content does; {added_or_changed, removed}."""
        state = self.table("files").select("file_path", "file_mtime", "file_size", "file_hash")
        listed = self._read(content=False)
        touched = N.changed_files(L.texts(self._read().join(N.changed_files(listed, state).select("file_path"), "file_path", "left_semi")), state, by=("file_hash",))
        gone = N.stale_paths(state, listed)
        path = f"{scratch(self.spark)}/refresh-{fingerprint({'store': self.store, 'v': self._current('files')})}"
        touched.write.mode("overwrite").parquet(f"{path}/touched")
        gone.write.mode("overwrite").parquet(f"{path}/gone")
        touched, gone = self.spark.read.parquet(f"{path}/touched"), self.spark.read.parquet(f"{path}/gone")
        counts = {"added_or_changed": touched.count(), "removed": gone.count()}
        if sum(counts.values()):
            self._commit(self._made(touched), touched.select("file_path").unionByName(gone))
        return counts

    def _commit(self, made: dict[str, DataFrame], touched: DataFrame | None) -> None:
        def merged(name: str, new: DataFrame) -> DataFrame:
            if touched is None:
                return new
            old = self.table(name)
            key = "file_path" if "file_path" in old.columns else "doc"
            out = touched.select(F.col("file_path") if key == "file_path" else F.xxhash64("file_path").alias("doc")).distinct()
            return old.join(out, key, "left_anti").unionByName(new, allowMissingColumns=True)

        done = {n: self._tables[n].write(merged(n, made[n])) for n in ("files", "symbols", "postings", "path_postings")}
        at = lambda n: self._tables[n].read(done[n])
        own = lambda n: at(n) if touched is None else at(n).join(made["docs"].select("doc"), "doc", "left_semi")
        done["docs"] = self._tables["docs"].write(merged("docs", I.measured(made["docs"], own("postings"), own("path_postings"))))
        new_files = at("files") if touched is None else made["files"]
        new_symbols = at("symbols") if touched is None else at("symbols").join(touched.select("file_path").distinct(), "file_path", "left_semi")
        done["points"] = self._tables["points"].write(merged("points", self._points(self._chunks(new_files, new_symbols))))
        if touched is None:
            imports, calls = G.import_edges(at("files")), G.call_sites(at("symbols"))
        else:
            gone = touched.select("file_path").distinct()
            # a path that comes or goes can change what other files' imports mean; else only the files touched are parsed
            paths = self.table("files").select("file_path")
            same = not at("files").select("file_path").exceptAll(paths).take(1) and not paths.exceptAll(at("files").select("file_path")).take(1)
            kept = self.table("imports").join(gone.withColumnRenamed("file_path", "source_file"), "source_file", "left_anti")
            imports = kept.unionByName(G.import_edges(new_files, at("files"))) if same else G.import_edges(at("files"))
            old = self.table("symbols").join(gone, "file_path", "left_semi").select(F.col("symbol_id").alias("caller_symbol_id")).distinct()
            calls = self.table("calls").join(old, "caller_symbol_id", "left_anti").unionByName(G.call_sites(new_symbols))
        done["imports"], done["calls"] = self._tables["imports"].write(imports), self._tables["calls"].write(calls)
        self._manifest.write(done)

    def info(self) -> dict:
        return {"name": self.name, "files": self.table("files").count(), "symbols": self.table("symbols").count(), "points": self.table("points").count(), "versions": self._manifest.read()}

    def folders(self, depth: int = 5, limit: int = 200) -> DataFrame:
        return L.folders(self.table("files"), depth, limit)

    def cache_status(self) -> dict:
        """How many files are as they were indexed."""
        listed, state = self._read(content=False), self.table("files")
        return {"cached": state.count(), "unchanged": N.unchanged_files(listed, state).count()}

    def warm(self) -> int:
        """Reads the index tables into memory; returns the number of postings."""
        self.table("docs").cache().count()
        return self.table("postings").cache().count()

    def watch(self, events: DataFrame, checkpoint: str, *, gap: str = "2 seconds", every: str = "5 seconds"):
        """Refreshes after every quiet gap in a stream of changes (path, ts)."""
        return feed.refreshing(feed.debounced(events, gap), lambda batch, _: self.refresh() if batch.take(1) else None, checkpoint, every)

    # asking

    def _text(self) -> tuple[DataFrame, I.TextIndex]:
        files = self.table("files").select(F.xxhash64("file_path").alias("doc"), "text")
        return files, I.TextIndex(self.table("docs"), self.table("postings"), self.table("path_postings"))

    def grep(self, literal: str, *, before: int = 0, after: int = 0, limit: int = 200, budget: int | None = None) -> DataFrame:
        """Matching lines; with a budget, those that fit it in tokens."""
        found = S.grep(self.table("files"), literal, before=before, after=after, limit=limit, key="file_path")
        return K.pack_lines(found, budget) if budget else found

    def artifact_packets(self) -> tuple[DataFrame, DataFrame]:
        """Of bundles and other artifacts: their rarest names as text (file_path, packet), and their strongest places."""
        held = self.table("files").where(H.artifact_bundle("file_path") | H.artifact_downgrade(F.col("text"), F.col("file_path"), F.col("language")))
        found = K.signals(held)
        return K.packet(found), K.hotspots(found)

    def index_in_background(self, operations: feed.Operations) -> tuple[feed.Operation, bool]:
        """Starts index(), or joins the run under way."""
        return operations.start("index", self.root, self.name, lambda stage: self.index())

    def text_search(self, query: str, *, limit: int = 20, **options) -> DataFrame:
        return S.search(*self._text(), query, limit=limit, **options)

    def symbol_lookup(self, query: str, *, limit: int = 50, **options) -> DataFrame:
        return Y.lookup(self.table("symbols"), query, limit=limit, **options)

    def extract_symbol(self, path: str, name: str) -> DataFrame:
        return Y.symbol(self.table("symbols"), name, path)

    def file_symbols(self, path: str, limit: int = 200) -> DataFrame:
        return Y.file_symbols(self.table("symbols"), path, limit)

    def find_callers(self, name: str, limit: int = 100) -> DataFrame:
        return G.callers(self.table("symbols"), self.table("calls"), name, limit)

    def trace_call_graph(self, name: str, *, direction: str = "both", max_depth: int = 5) -> tuple[DataFrame, DataFrame]:
        """Nodes (symbols with level) and edges that leave them; call_cycles has the cycles among them."""
        symbols = self.table("symbols")
        edges = G.call_edges(symbols, self.table("calls"))
        start = symbols.where((F.lower("name") == name.lower()) & (F.col("kind") != "import")).select(F.col("symbol_id").alias("node"))
        nodes = G.trace(self.spark, edges, start, depth=max_depth, direction=direction)
        return nodes.join(symbols.select(F.col("symbol_id").alias("node"), "name", "file_path", "line_start"), "node"), G.trace_edges(edges, nodes, max_depth)

    def call_cycles(self, name: str, *, direction: str = "both", max_depth: int = 5, most: int = 4) -> DataFrame:
        """(length, nodes): cycles of up to `most` symbols among those that a trace reaches."""
        nodes, edges = self.trace_call_graph(name, direction=direction, max_depth=max_depth)
        inside = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
        return G.cycles(inside.select("src", "dst"), most)

    def import_graph(self, path: str) -> DataFrame:
        return self.table("imports").where(F.col("source_file") == path)

    def find_importers(self, path: str) -> DataFrame:
        return self.table("imports").where(F.col("target_file") == path)

    def import_neighbours(self, path: str) -> DataFrame:
        return G.neighbours(self.table("imports"), path)

    def skeleton(self, max_depth: int = 20) -> DataFrame:
        return Y.skeleton(self.table("files"), self.table("symbols"), max_depth=max_depth)

    def protocol_search(self, query: str, **options) -> DataFrame:
        return R.contracts(self.table("files"), query, **options)

    def pattern_search(self, pattern: str, limit: int = 50) -> DataFrame:
        return X.search(self.table("files"), pattern).orderBy("file_path", "start").limit(limit)

    def pattern_rewrite(self, pattern: str, template: str) -> DataFrame:
        return X.rewrite_files(self.table("files"), pattern, template)

    def file_read(self, path: str, start: int = 1, end: int | None = None, max_bytes: int | None = None) -> DataFrame:
        return E.read_lines(self.table("files"), path, start, end, max_bytes)

    def file_edit(self, path: str, edits: list[E.Edit], expected: str | None = None, edit_id: str = "edit") -> tuple[DataFrame, DataFrame]:
        return E.edit(self.table("files"), path, edits, expected, edit_id)

    # by meaning

    def _ranked(self, text: str, vector: str, limit: int, cond: Column, weight: float, bias: str | None) -> DataFrame:
        """One vector space: nearest points, rescored by payload, ranked."""
        words = T.keywords_py(text, 20)
        q = self.spark.createDataFrame([(0, self.embed_query(text))], "query_id int, query_vector array<float>")
        near = V.knn(self.table("points"), q, V.overfetch(limit, len(words), hybrid=True), vector=vector, key="chunk_id", where=cond)
        rows = near.join(self.table("points").drop("code", "description_vec", "source"), "chunk_id")
        rated = B.rescore(rows, words, rules=self.rules, weight=V.BIAS[bias].keywords if bias else weight)
        return V.ranked(rated, key="chunk_id")

    def semantic_search(self, text: str, *, limit: int = 5, mode: str = "hybrid", language: str | None = None, path_prefix: str | None = None, kinds: list[str] | None = None, keyword_weight: float = 0.3, bias: str | None = None, include_source: bool = True) -> DataFrame:
        """mode: code, description or hybrid (both, fused). Sources are joined to the final rows only. bias: a preset of
        V.BIAS, in place of mode and weights; it may return more, and rerank by the question's tokens."""
        cond = V.payload_filter(language=language, prefix=path_prefix, kinds=kinds)
        preset = V.BIAS[bias] if bias else None
        mode, limit = (preset.mode, max(1, int(limit * preset.factor))) if preset else (mode, limit)
        spaces = {"code": ["code"], "description": ["description_vec"], "hybrid": ["code", "description_vec"]}[mode]
        both = dict(enumerate(preset.weights)) if preset else {0: 0.5, 1: 0.5}
        return self._fused([(text, s) for s in spaces], both if len(spaces) > 1 else {0: 1.0}, limit, cond, keyword_weight, bias, include_source, T.keywords_py(text, 20))

    def structured_search(self, text: str, *, limit: int = 5, language: str | None = None, path_prefix: str | None = None, include_source: bool = True) -> DataFrame:
        """Lines `lex:`, `vec:` and `hyde:`, each a ranked list of its own; the first counts twice."""
        parts = V.structured(text)
        cond = V.payload_filter(language=language, prefix=path_prefix)
        lists = [(p.text, "code" if p.kind != "hyde" else "description_vec") for p in parts]
        weight = 0.45 if any(p.kind == "lex" for p in parts) else 0.3
        return self._fused(lists, V.structured_weights(parts), limit, cond, weight, None, include_source, T.keywords_py(" ".join(p.text for p in parts), 20))

    def _fused(self, lists: list[tuple[str, str]], weights: dict[int, float], limit: int, cond: Column, weight: float, bias: str | None, include_source: bool, words: list[str]) -> DataFrame:
        found = None
        for i, (text, space) in enumerate(lists):
            part = self._ranked(text, space, limit, cond, weight, bias).select("query_id", "chunk_id", "rank", "score", F.col("symbol_kind").alias("kind"), F.lit(i).alias("list"))
            found = part if found is None else found.unionByName(part)
        fused = V.ranked(V.rrf(found, weights, key="chunk_id"), key="chunk_id")
        placed = fused.join(self.table("points").select("chunk_id", "file_path"), "chunk_id")
        if bias and V.BIAS[bias].rerank:
            placed = self._reranked(placed.where(F.col("rank") <= V.overfetch(limit, rerank=True)), " ".join(t for t, _ in lists))
        top = V.diversify(placed, limit, key="chunk_id", many_keywords=len(words) >= 10).select("chunk_id", "query_id", "score", F.col("place").alias("rank"))
        shown = self.table("points").drop("code", "description_vec", "dedup_hash", *([] if include_source else ["source"]))
        return shown.join(F.broadcast(top), "chunk_id").orderBy("rank")  # at most `limit` rows

    def _reranked(self, placed: DataFrame, text: str) -> DataFrame:
        """Candidates in the order of their scores blended with late interaction: how many of the question's tokens the
        source has a token for (vectors of single tokens are one or nothing)."""
        asked = T.query_tokens(text)
        q = F.array(*[F.lit(t) for t in asked]) if asked else F.array().cast("array<string>")
        held = self.table("points").select("chunk_id", "source").join(F.broadcast(placed), "chunk_id")
        rated = held.withColumn("rerank_score", F.size(F.array_intersect(T.unique_tokens("source"), q)).cast("double")).drop("source")
        return V.ranked(V.rerank_blend(rated, key="chunk_id").drop("rank").withColumn("score", F.col("blended")), key="chunk_id")

    def semantic_bundle(self, text: str, *, anchors: int = 3, related: int = 8) -> tuple[DataFrame, DataFrame]:
        """Anchors, and companions: tools, semantic neighbours and import neighbours."""
        wide = max(anchors, 1) * 4
        found = self.semantic_search(text, limit=max(wide, 20) if C.wants_bundle(text) else wide, include_source=False)
        return C.bundle(found, self.table("imports"), text, anchors=anchors, related=related)

    def related_callers(self, results: DataFrame, limit: int = 8) -> DataFrame | None:
        """Who calls the first result (by rank), if it can be called: each place once."""
        order = [c for c in ("rank", "place") if c in results.columns][:1] or [F.desc("score")]
        top = results.orderBy(*order).select("symbol_name", "symbol_kind").first()
        if not top or top.symbol_kind not in ("function", "method"):
            return None
        return self.find_callers(top.symbol_name, limit).dropDuplicates(["file_path", "caller", "caller_line"]).withColumn("symbol", F.lit(top.symbol_name))

    def _hits(self, question: str, limit: int) -> DataFrame:
        return self.text_search(" ".join(T.keywords_py(question, 20)) or question, limit=limit, intent_mode=True)

    def focused(self, results: DataFrame, question: str) -> DataFrame:
        """Results (file_path, score, symbol_kind and what else) whose artifacts are shown at the place that answers best."""
        whole = [r for r in results.where(F.col("symbol_kind") == "file_artifact").select("file_path", "score").distinct().collect()]
        if not whole:  # at most as many as results
            return results
        words, files = T.keywords_py(question, 20), self.table("files")
        found = [C.focus(files, r.file_path, words, project=self.name, score=r.score) for r in whole]
        best = None
        for f in found:
            best = f if best is None else best.unionByName(f)
        best = best.select("file_path", F.col("line_start").alias("_a"), F.col("line_end").alias("_b"), F.col("score").alias("_s"), F.col("snippet").alias("_t"))
        joined = results.join(F.broadcast(best), "file_path", "left")
        pick = {"line_start": "_a", "line_end": "_b", "score": "_s", "source": "_t"}
        hit = F.col("_s").isNotNull() & (F.col("symbol_kind") == "file_artifact")
        columns = [F.when(hit, F.col(pick[c])).otherwise(F.col(c)).alias(c) if c in pick else F.when(hit, F.lit("<artifact_focus>")).otherwise(F.col(c)).alias(c) if c == "symbol_name" else F.col(c) for c in results.columns]
        return joined.select(*columns)

    def text_context(self, question: str, *, limit: int = 5, related: int = 8, hits: DataFrame | None = None) -> Context:
        """Text hits as the answer; beside them files of the same module, import neighbours and other hits."""
        hits = self._hits(question, max(limit + related, 8)) if hits is None else hits
        split = C.split_text(hits, question, limit + related).join(hits.drop("score"), "path")
        first = split.withColumn("n", F.row_number().over(Window.orderBy(F.col("part") != "seed", F.desc("score"), "path", "line_start")))
        primary = C.text_results(first.where(F.col("n") <= limit).drop("n", "part"))
        seeds = [r.file_path for r in primary.orderBy(F.desc("score"), "file_path").limit(2).collect()]
        asked = T.keywords_py(question)
        lists = [C.module_local(self.table("files"), s, asked, related) for s in seeds[:1]]
        taken = self.spark.createDataFrame([(s,) for s in seeds], "file_path string")
        lists.append(C.import_related(self.table("imports"), taken, asked, related))
        lists.append(C.lexical_related(first.where(F.col("n") > limit).select("path", "score"), primary, question, related))
        merged = C.merge_related([x.select("file_path", "relation", "seed_file", "distance") for x in lists])
        beside = merged.join(primary.select("file_path").distinct(), "file_path", "left_anti").orderBy("source_list", "distance", "file_path").limit(related)
        return Context("text", self.focused(primary, question).orderBy(F.desc("score"), "file_path"), beside)

    def _symbol_context(self, question: str, name: str, limit: int) -> Context | None:
        """The symbols meant; for questions about behaviour, what the first one uses; callers where a bundle is wanted."""
        found = C.prioritise(self.symbol_lookup(name, limit=limit), name)
        top = found.first()
        if top is None:
            return None
        if C.wants_helpers(question) and limit > 1:
            used = C.helpers(self.table("symbols"), top.file_path, top.name, limit - 1)
            listed = C.merge_symbols([found.limit(1), used, found])
            found = self.table("symbols").join(F.broadcast(listed.orderBy("list", "line_start").limit(limit)), ["file_path", "name", "kind", "line_start", "line_end"]).orderBy("list", "line_start")
        if not C.wants_bundle(question):
            return Context("symbol", found)
        seed = self.spark.createDataFrame([(top.file_path,)], "file_path string")
        beside = C.import_related(self.table("imports"), seed, T.keywords_py(question)) if C.is_graph_question(question) else None
        return Context("symbol_bundle", found, beside, self.find_callers(top.name, 8))

    def retrieve_context(self, question: str, *, limit: int = 5, related: int = 8) -> Context:
        """The way that fits a question: symbols for an identifier, text hits where they tell enough or there are no vectors,
        a bundle for broad questions, else semantic hits with lexical companions, and for questions about imports and
        calls those of a second search."""
        name = C.symbol_candidate(question)
        answer = self._symbol_context(question, name, limit) if name else None
        if answer:
            return answer
        vectors, about_graph = self._current("points") is not None, C.is_graph_question(question)
        hits = None
        if not about_graph or not vectors:
            hits = self._hits(question, max(limit + related, 8))
            head = hits.orderBy(F.desc("score"), "path").limit(5).select("path", "matched", C.skip_path(F.col("path"), question).alias("skip")).collect()
            if head and (not vectors or C.text_is_primary([(r.path, r.matched) for r in head], question, {r.path for r in head if r.skip})):
                return self.text_context(question, limit=limit, related=related, hits=hits)
        if not vectors:
            return Context("text", C.text_results(hits))
        if C.wants_bundle(question):
            anchors, beside = self.semantic_bundle(question, anchors=limit, related=related)
            return Context("bundle", anchors, beside, self.related_callers(anchors))
        found = self.focused(self.semantic_search(question, limit=limit), question)
        lexical = C.lexical_related(self._hits(question, max(related * 4, 12)), found, question, related)
        if about_graph:
            taken = found.select("file_path").unionByName(lexical.select("file_path"))
            graph = C.lexical_related(self._hits(C.graph_query(question), max(related * 4, 12)), taken, question, related).withColumn("relation", F.lit("graph_lexical_neighbor"))
            lexical = C.interleave(lexical, graph, related)
            order = C.promote(found, lexical, limit)
            return Context("semantic", order, lexical, self.related_callers(found))
        return Context("semantic", found, lexical)

    def instructions(self) -> str:
        return C.instructions(self.name, self.table("points").count() if self._current("points") else 0)
