"""Token budgets, compression of source, boundary-aware chunks, artifact signals: what must go line by line."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_piece = re.compile(r"\w+|[^\w\s]")


def tokens_of(text: Column) -> Column:
    """About how many model tokens a text has: a word counts one for every six characters begun, a sign counts one."""
    found = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), F.lit(1))
    return F.aggregate(found, F.lit(0), lambda a, w: a + F.ceil(F.length(w) / 6.0).cast("int"))


def count_tokens(text: str) -> int:
    return sum(-(-len(w) // 6) for w in _piece.findall(text))


def pack_prefix(results: DataFrame, budget: int, *, cost: str = "tokens", by: str = "query_id", score: str = "score", key: str = "key") -> DataFrame:
    """The best results as long as their running sum stays within the budget."""
    order = Window.partitionBy(by).orderBy(F.desc(score), key).rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("used", F.sum(cost).over(order)).where(F.col("used") <= budget)


def truncate(source: str, budget: int) -> tuple[str, bool]:
    """Whole lines within the budget, and a mark."""
    if count_tokens(source) <= budget:
        return source, False
    mark = "    # ... (truncated)"
    left = budget - count_tokens(mark)
    if left <= 0:
        return mark, True
    kept: list[str] = []
    for line in source.split("\n"):
        left -= count_tokens(line)
        if left < 0:
            break
        kept.append(line)
    return "\n".join([*(kept or source.split("\n")[:1]), mark]), True


def pack_greedy(results: DataFrame, budget: int, *, least: int = 64, compress: str | None = None, by: str = "query_id", score: str = "score", key: str = "key", meta: str = "meta", source: str = "source", language: str | None = None) -> DataFrame:
    """(by, key, score, source, tokens, truncated): best first; what doesn't fit even shortened to `least` tokens is
    skipped and the next is tried. Runs once a query over its ranked results, which are few."""
    columns = [F.col(by).alias("q"), F.col(key).alias("k"), F.col(score).alias("s"), F.coalesce(meta, F.lit("")).alias("m"), F.coalesce(source, F.lit("")).alias("t"), (F.col(language) if language else F.lit(None).cast("string")).alias("l")]

    def run(table: pd.DataFrame) -> pd.DataFrame:
        out, used = [], 0
        for r in table.sort_values(["s", "k"], ascending=[False, True]).itertuples(index=False):
            head = count_tokens(r.m)
            left = budget - used - head
            if left < least:
                continue
            text = compress_source(r.t, compress, r.l) if compress else r.t
            text, cut = truncate(text, left)
            used += head + count_tokens(text)
            out.append((r.q, r.k, r.s, text, head + count_tokens(text), cut))
        return pd.DataFrame(out, columns=["q", "k", "s", "t", "n", "c"])

    frame = results.select(*columns)
    types = dict(frame.dtypes)
    packed = frame.groupBy("q").applyInPandas(run, f"q {types['q']}, k {types['k']}, s {types['s']}, t string, n long, c boolean")
    return packed.select(F.col("q").alias(by), F.col("k").alias(key), F.col("s").alias(score), F.col("t").alias(source), F.col("n").alias("tokens"), F.col("c").alias("truncated"))


def pack_lines(found: DataFrame, budget: int, *, file: str = "file_path", line: str = "line", at: str = "line_number") -> DataFrame:
    """Grep results in order of file and line, as long as they fit: what doesn't is skipped and shorter ones after it are
    tried; adds `tokens`. Runs over the results of one search, which its limit bounds."""
    rows = found.withColumn("tokens", tokens_of(F.concat(F.col(file), F.lit(":"), F.col(at), F.lit(": "), F.col(line))))
    kind = rows.schema

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table, used, keep = table.sort_values([file, at]), 0, []
        for n in table["tokens"]:
            keep.append(used + n <= budget)
            used += n if keep[-1] else 0
        return table[keep]

    return rows.groupBy(F.lit("all")).applyInPandas(run, kind)


def pack_text(text: str, budget: int) -> tuple[str, bool]:
    """Lines of a rendered tree within a budget."""
    return truncate(text, budget)


LINE_COMMENTS = {"python": r"^\s*#", "ruby": r"^\s*#", "bash": r"^\s*#", "yaml": r"^\s*#", "toml": r"^\s*#", "r": r"^\s*#", "sql": r"^\s*--", "lua": r"^\s*--", "haskell": r"^\s*--"} | dict.fromkeys("javascript typescript tsx rust go java c cpp csharp php swift scala zig protobuf".split(), r"^\s*//")
IMPORTS = {"python": r"^\s*(import|from)\s", "rust": r"^\s*(pub\s+)?use\s", "go": r"^\s*import\b", "java": r"^\s*import\s", "csharp": r"^\s*using\s", "c": r"^\s*#include", "cpp": r"^\s*#include"} | dict.fromkeys(("javascript", "typescript", "tsx"), r"^\s*(import\b|const .*require\()")


def _collapse(lines: list[str]) -> list[str]:
    out = []
    for x in lines:
        if x.strip() or not out or out[-1].strip():
            out.append(x)
    while out and not out[-1].strip():
        out.pop()
    return out


def _uncomment(lines: list[str], language: str) -> list[str]:
    """Without comments; the first block comment (or docstring) stays, later ones go as a whole."""
    single = re.compile(LINE_COMMENTS[language]) if language in LINE_COMMENTS else None
    openers = ('"""', "'''") if language == "python" else ("/*",) if single and single.pattern.endswith("//") else ()
    out, closing, keep, seen = [], "", False, False
    for x in lines:
        s = x.strip()
        if closing:
            if keep:
                out.append(x)
            if closing in s:
                closing = ""
            continue
        opener = next((o for o in openers if s.startswith(o)), None)
        if opener:
            keep, seen = not seen, True
            if keep:
                out.append(x)
            end = "*/" if opener == "/*" else opener
            if end not in s[len(opener) :]:
                closing = end
            continue
        if single and single.match(x):
            continue
        out.append(x)
    return out


def _fold_imports(lines: list[str], language: str) -> list[str]:
    pattern = re.compile(IMPORTS[language]) if language in IMPORTS else None
    if not pattern:
        return lines
    out, run = [], []
    for x in [*lines, None]:
        if x is not None and (pattern.match(x) or (run and not x.strip())):
            run.append(x)
            continue
        if len(run) > 2:
            out.append(f"{run[0][: len(run[0]) - len(run[0].lstrip())]}# ... ({len(run)} import lines collapsed)")
        else:
            out += run
        run = []
        if x is not None:
            out.append(x)
    return out


def compress_source(source: str, level: str | None = "medium", language: str | None = None) -> str:
    """light: blank lines; medium: comments too; aggressive: runs of imports and trivial property bodies too."""
    lang = (language or "").lower()
    lines = _collapse([x.rstrip() for x in source.split("\n")])
    if level in ("medium", "aggressive") and lang:
        lines = _collapse(_uncomment(lines, lang))
    if level == "aggressive" and lang:
        lines = _fold_imports(lines, lang)
        if lang == "python":
            for i in range(len(lines) - 2):
                if re.match(r"^\s*@(property|\w+\.setter)", lines[i]) and "def " in lines[i + 1] and re.match(r"^\s*(pass|return self\._?\w+|self\._?\w+ = \w+)\s*(#.*)?$", lines[i + 2]):
                    lines[i + 2] = lines[i + 2][: len(lines[i + 2]) - len(lines[i + 2].lstrip())] + "..."
        lines = _collapse(lines)
    return "\n".join(lines)


def compressed(files: DataFrame, level: str = "medium", *, text: str = "text", language: str = "language", out: str = "compressed") -> DataFrame:
    """light stays in the JVM; the others follow the text line by line in Arrow batches."""
    if level == "light":
        tidy = F.regexp_replace(F.regexp_replace(text, r"[ \t\r]+(?=\n|$)", ""), r"\n{3,}", "\n\n")
        return files.withColumn(out, F.regexp_replace(tidy, r"\n+$", ""))

    @F.pandas_udf("string")
    def run(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else compress_source(t, level, x) for t, x in zip(texts, languages)])

    return files.withColumn(out, run(F.col(text), F.col(language)))


def grep_line(line: Column) -> Column:
    return F.regexp_replace(F.rtrim(line), r"[ \t]+", " ")


BOUNDARIES = [(re.compile(p), s) for p, s in ((r"\n#{1,6}\s", 100), (r"\n```", 90), (r"\n\n+", 60), (r"\n[-*]\s", 25), (r"\n\d+\.\s", 25), (r"\n", 1))]


def chunk_end(text: str, start: int, target: int, reach: int = 1200, least: int = 256) -> int:
    """A good place at or before `target` to end a chunk: headings, fences, blank lines, list items; never in a fence."""
    if target >= len(text):
        return len(text)
    low = max(start + least, target - reach)
    window = text[low:target]
    size, best, place = max(1, len(window)), -1.0, None
    for pattern, worth in BOUNDARIES:
        for m in pattern.finditer(window):
            value = worth - (size - m.start()) / size * 15
            if value > best:
                best, place = value, m.start()
    if place is None or low + place <= start or text.count("\n```", start, low + place) % 2:
        return target
    return low + place


def chunk_text(text: str, size: int = 4000) -> list[tuple[int, int]]:
    out, at = [], 0
    while at < len(text):
        end = max(chunk_end(text, at, at + size), at + 1)
        out.append((at, end))
        at = end
    return out


def chunk_files(files: DataFrame, size: int = 4000) -> DataFrame:
    """(file_path, language, no, start, end, line_start, line_end, source): texts cut at good places; the parts joined
    are the text. Texts are worked on one by one; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, language, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows, line = [], 1
                for i, (a, b) in enumerate(chunk_text(text or "", size)):
                    part = text[a:b]
                    ends = line + part.count("\n") - (part.endswith("\n") and b > a)
                    rows.append((path, language, i, a, b, line, max(line, ends), part))
                    line += part.count("\n")
                if rows:
                    kinds = [pa.string(), pa.string(), *[pa.int64()] * 5, pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["file_path", "language", "no", "start", "end", "line_start", "line_end", "source"])

    return files.select("file_path", "language", "text").mapInArrow(run, "file_path string, language string, no long, start long, end long, line_start long, line_end long, source string")


SIGNALS = {"service": r"\b([A-Z]\w*(?:Service|Client|Manager|Controller|Provider|Repository))\b", "type": r"\b(?:class|interface|enum|struct)\s+([A-Za-z_]\w+)", "method": r"\b(?:function|def|fn|func)\s+([A-Za-z_]\w+)", "call": r"\b(\w+(?:\.\w+)+)\s*\(", "field": r"[\"']([a-z]\w{2,40})[\"']\s*:", "string": r"[\"']([^\"'\n]{12,120})[\"']"}


def signals(files: DataFrame, most: int = 12) -> DataFrame:
    """(file_path, kind, value, offset, count, rarity, rank): names in artifacts, rarest first; rarity is the sum of 1/df
    over a value's parts, df being the number of files."""
    def told(kind: str, pattern: str) -> Column:
        values = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
        one = lambda vs: F.transform(F.array_distinct(vs), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.size(F.filter(vs, lambda x: x == v)).cast("long").alias("count"), (F.instr(F.col("text"), v) - 1).alias("offset")))
        return F.flatten(F.transform(F.array(values), one))

    # counted and placed inside the row: no text goes on with a value
    rows = files.select("file_path", F.explode(F.concat(*[told(k, p) for k, p in SIGNALS.items()])).alias("s")).select("file_path", "s.*")
    found = rows.groupBy("file_path", "kind", "value").agg(F.sum("count").alias("count"), F.min("offset").alias("offset"))
    parts = found.select("file_path", "kind", "value", F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace("value", "(?<=[a-z0-9])(?=[A-Z])", " ")), r"[^a-z0-9]+"))).alias("part")).where("part != ''")
    df = parts.groupBy("part").agg(F.countDistinct("file_path").alias("df"))
    rare = parts.join(df, "part").groupBy("file_path", "kind", "value").agg(F.sum(F.lit(1.0) / F.col("df")).alias("rarity"))
    order = Window.partitionBy("file_path", "kind").orderBy(F.desc("rarity"), "value")
    return found.join(rare, ["file_path", "kind", "value"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("file_path", "kind", "value", "offset", "count", "rarity", "rank")


def hotspots(found: DataFrame, spacing: int = 240, most: int = 8) -> DataFrame:
    """(file_path, offset, score): the strongest places of each file, at least `spacing` characters apart."""
    base = {"service": 3.0, "type": 2.5, "method": 2.0, "call": 1.5, "field": 1.0, "string": 0.5}

    def run(table: pd.DataFrame) -> pd.DataFrame:
        rows = sorted((-(base[r.kind] + 0.85 * min(r.count, 5) + r.rarity), r.offset, r.file_path) for r in table[["kind", "count", "rarity", "offset", "file_path"]].itertuples(index=False, name="R") for r in [_Row(*r)])
        out: list[tuple] = []
        for s, at, path in rows:
            if len(out) < most and all(abs(at - x[1]) >= spacing for x in out):
                out.append((path, at, -s))
        return pd.DataFrame(out, columns=["file_path", "offset", "score"])

    return found.groupBy("file_path").applyInPandas(run, "file_path string, offset long, score double")


class _Row:
    def __init__(self, kind: str, count: int, rarity: float, offset: int, file_path: str):
        self.kind, self.count, self.rarity, self.offset, self.file_path = kind, count, rarity, offset, file_path


def packet(found: DataFrame) -> DataFrame:
    """(file_path, packet): the signals as text, a line a kind."""
    lines = found.groupBy("file_path", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]), ", ").alias("v"))
    return lines.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "v"))), lambda x: F.concat(x["kind"], F.lit(": "), x["v"])), "\n").alias("packet"))
