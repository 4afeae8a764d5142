"""Ranked text search, literal search with context, snippets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import paths as P
from textquarry.functions import query as Q
from textquarry.functions import tokens as T
from textquarry.functions.intent import LEVELS, Intent, intent
from textquarry.operators import text_index as I

#: Words that show that a query is about such files, so that these aren't held back.
FOCUS = {
    "documentation": "manual guides guide readme documentation docs doc",
    "test": "pytest unittest regression specs spec tests test",
    "config": "schemas schema settings configuration configs config",
    "generated": "workers worker ui styles style svelte routes route renderer html front-end frontend dom css components component chunks chunk assets asset",
    "tooling": "timing instrumentation scripts script tooling phase coverage latency benchmark",
}


def _about(topic: str, terms: list[str]) -> bool:
    return bool(set(FOCUS[topic].split()) & set(terms))


def category_boost(path: Column, terms: list[str]) -> Column:
    boosts = {c: 1.0 if c in FOCUS and _about(c, terms) else b for c, b in P.CATEGORY_BOOSTS.items()}
    return P.table(boosts, P.file_category(path), 1.0)


def tooling_penalty(path: Column, terms: list[str]) -> Column:
    if _about("tooling", terms):
        return F.lit(1.0)
    p = P.normal_path(path)
    tooling = p.contains("/scripts/") | p.startswith("scripts/") | p.contains("benchmark") | p.endswith("_cases.json") | p.endswith(".bench.rs")
    return F.when(tooling, 0.15).otherwise(1.0)


def path_boost(path: Column, terms: list[str]) -> Column:
    """More for query words in the path, still more in the base name; 1.42 at most."""
    words = sorted({t.lower() for t in terms if len(t) >= 3})
    if not words:
        return F.lit(1.0)
    asked = F.array(*[F.lit(w) for w in words])
    hits = F.size(F.array_intersect(T.path_tokens(path), asked))
    named = F.size(F.array_intersect(T.path_tokens(P.file_name(path)), asked))
    return F.when(hits == 0, 1.0).otherwise(F.least(F.lit(1.0) + hits * 0.16 + named * 0.10, F.lit(1.42)))


def intent_boost(matched: Column, wanted: Intent) -> Column:
    if not wanted.exact and not wanted.expanded:
        return F.lit(1.0)
    held = lambda words: F.lit(0) if not words else F.size(F.filter(matched, lambda t: F.lower(t).isin(*words)))
    exact = held(wanted.exact)
    wider = held([w for w in wanted.expanded if w not in wanted.exact])
    share = lambda hits, words: hits / F.lit(len(words)) if words else F.lit(0.0)
    boost = (F.lit(1.0) + exact * 0.22) * (F.lit(1.0) + wider * LEVELS[wanted.level][2])
    coverage = F.lit(1.0) + share(exact, wanted.exact) * 0.2 + share(wider, wanted.expanded) * 0.08
    return boost * coverage * F.when((exact == 0) & (wider > 0), 0.85).otherwise(1.0)


def matched_coverage(matched: Column, terms: list[str]) -> Column:
    words = sorted({t.lower() for t in terms})
    if not words:
        return F.lit(1.0)
    hits = F.size(F.array_intersect(F.transform(matched, F.lower), F.array(*[F.lit(w) for w in words])))
    return F.lit(1.0) + hits / F.lit(len(words)) * 0.22


def snippet(text: Column, matched: Column, around: int = 3) -> Column:
    """struct(snippet, line_start, line_end): the lines about the first one that holds a matched term (else the first)."""
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  (binds what is used more than once)
    clean = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    places = lambda low: F.filter(F.transform(matched, lambda t: F.instr(low, t)), lambda i: i > 0)
    # the first hit in the text tells the line: by the line ends before it
    head = lambda plain: once(F.lower(plain), lambda low: F.substring(low, F.lit(1), F.array_min(places(low)) - 1))
    line = lambda plain: F.coalesce(once(head(plain), lambda h: F.length(h) - F.length(F.replace(h, F.lit("\n"), F.lit(""))) + 1), F.lit(1))
    lines = lambda plain: F.split(F.when(plain.endswith("\n"), F.substring(plain, F.lit(1), F.length(plain) - 1)).otherwise(plain), "\n")
    found = once(clean, lambda plain: F.struct(lines(plain).alias("ls"), line(plain).alias("n")))

    def cut(x: Column) -> Column:
        first = F.least(x["n"], F.size(x["ls"]))
        start, end = F.greatest(first - around, F.lit(1)).cast("int"), F.least(first + around, F.size(x["ls"])).cast("int")
        return F.struct(F.array_join(F.slice(x["ls"], start, end - start + 1), "\n").alias("snippet"), start.alias("line_start"), end.alias("line_end"))

    none = (F.length(text) == 0) | (F.size(matched) == 0)
    return F.when(none, F.struct(F.lit("").alias("snippet"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"))).otherwise(once(found, cut))


def search(files: DataFrame, index: I.TextIndex, text: str, *, limit: int = 10, intent_mode: bool = False, intent_level: int = 2, key: str = "doc", body: str = "text") -> DataFrame:
    """(path, language, score, matched, snippet, line_start, line_end, truncated), best first; ties by path.

    Terms are scored over the raw query (filters and operators too), 4 * limit candidates are taken, the boolean
    expression holds over those, and boosts by category, coverage, role, path and intent reorder them. Where the
    expression is only an OR of words, texts are read for the final rows alone.
    """
    parsed = Q.parse(text)
    if parsed.expr is None:
        raise ValueError("the query has no words to look for")
    wanted = intent(text, intent_level) if intent_mode else Intent([], [], 2)
    terms = list(dict.fromkeys(t for w in (*wanted.exact, *wanted.expanded) for t in T.query_tokens(w))) if intent_mode else T.query_tokens(parsed.raw)
    scored = I.asked(index, {"q": " ".join([parsed.raw.strip(), *wanted.expanded])})
    docs = index.docs.where(Q.filter_condition(parsed.filter, F.col("path"), F.col("language"))).select("doc", "path", "language")
    best = scored.where("score > 0").join(docs, "doc").orderBy(F.desc("score"), "path", "doc").limit(max(4 * limit, limit + 2))
    boost = category_boost(F.col("path"), terms) * tooling_penalty(F.col("path"), terms) * path_boost(F.col("path"), terms) * intent_boost(F.col("matched"), wanted)
    texts = files.select(F.col(key).alias("doc"), F.col(body).alias("body"))
    order = [F.desc("score"), "path", "doc"]
    if Q.plain(parsed.expr):
        top = best.withColumn("score", F.col("score") * boost * matched_coverage(F.col("matched"), terms)).orderBy(*order).limit(limit + 1)
        found = texts.join(F.broadcast(top), "doc")
    else:
        read = texts.join(F.broadcast(best), "doc").where(Q.condition(parsed.expr, F.lower("body")))
        found = read.withColumn("score", F.col("score") * boost * P.coverage_boost("body", terms) * P.role_boost(P.content_role("body"))).orderBy(*order).limit(limit + 1)
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("truncated", F.max("rank").over(Window.partitionBy()) > limit)
    shown = ranked.where(F.col("rank") <= limit).withColumn("s", snippet(F.col("body"), F.col("matched")))
    return shown.select("path", "language", "score", "matched", "s.snippet", "s.line_start", "s.line_end", "truncated").orderBy(F.desc("score"), "path")


def lines(files: DataFrame, *, key: str = "path", text: str = "text") -> DataFrame:
    """(key, line_number from 1, line), without carriage returns; a final line end begins no line."""
    body = F.regexp_replace(F.col(text), "\n$", "")
    return files.select(F.col(key), F.posexplode(F.split(body, "\n")).alias("i", "l")).select(key, (F.col("i") + 1).alias("line_number"), F.regexp_replace("l", "\r$", "").alias("line"))


def grep(files: DataFrame, literal: str, *, before: int = 0, after: int = 0, limit: int | None = 200, key: str = "path", text: str = "text") -> DataFrame:
    """Literal, case-sensitive matches, the first of each line: key, line_number, column_start, column_end (from 1),
    line, context_before, context_after; ordered by file, line and column.

    Hits and their context are cut from the array of the file's own lines inside the row, so only they are spread, and
    nothing is shuffled but the final sort; files without the literal are left out before they are split.
    """
    body = F.transform(F.split(F.regexp_replace(F.col(text), "\n$", ""), "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    lead = lambda ls, i: F.slice(ls, F.greatest(i + 1 - before, F.lit(1)), i - F.greatest(i - before, F.lit(0)))
    tail = lambda ls, i: F.slice(ls, i + 2, F.least(F.lit(after), F.size(ls) - i - 1))
    shown = lambda ls, i: F.struct(i.alias("i"), F.get(ls, i).alias("line"), lead(ls, i).alias("lead"), tail(ls, i).alias("tail"))
    places = lambda ls: F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: F.contains(F.get(ls, i), F.lit(literal)))
    hits = F.flatten(F.transform(F.array(body), lambda ls: F.transform(places(ls), lambda i: shown(ls, i))))
    found = files.where(F.col(text).contains(literal)).select(key, F.explode(hits).alias("h")).select(key, "h.*")
    n, lead, tail, start = F.col("i"), F.col("lead"), F.col("tail"), F.instr("line", literal)
    out = found.select(key, (n + 1).alias("line_number"), start.alias("column_start"), (start + len(literal)).alias("column_end"), "line", lead.alias("context_before"), tail.alias("context_after")).orderBy(key, "line_number", "column_start")
    return out.limit(limit) if limit else out


def phrase_or_terms(expr: Q.Expr) -> list[str]:
    """The words of a query tree, in order."""
    if isinstance(expr, Q.Term):
        return expr.keywords
    return list(reduce(lambda a, b: a + b, (phrase_or_terms(e) for e in (expr.left, expr.right))))
