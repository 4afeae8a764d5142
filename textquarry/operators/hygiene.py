"""Chunks: identity, deduplication by content and context, quality, filters and caps, descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import tokens as T

MIN_BYTES, MAX_LINE, MEAN_LINE, PER_FILE, TOTAL, MAX_BYTES = 120, 1200, 220, 180, 50_000, 32_000
#: What makes two chunks the same for descriptions and vectors.
CONTEXT = ("source", "symbol_name", "symbol_kind", "parent", "signature", "docstring")


def _opt(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def chunk_id(df: DataFrame) -> Column:
    """SHA-256 of path, name, kind and, where they are known, parent, signature and byte span."""
    parts = [F.col("file_path"), F.col("symbol_name"), F.col("symbol_kind")]
    parent, signature = _opt(df, "parent"), _opt(df, "signature")
    span = F.concat(F.lit("span="), F.col("byte_start").cast("string"), F.lit(":"), F.col("byte_end").cast("string")) if "byte_start" in df.columns else F.lit(None).cast("string")
    return F.sha2(F.concat_ws("::", *parts, F.when(parent != "", parent), F.when(signature != "", F.concat(F.lit("sig="), signature)), span), 256)


def dedup_hash(df: DataFrame) -> Column:
    return F.sha2(F.concat_ws("\n\x00", *[_opt(df, c) for c in CONTEXT]), 256)


def dedup(chunks: DataFrame, *, order: str = "chunk_id") -> DataFrame:
    """Chunks with dedup_hash, group_size and is_representative (the least by `order`)."""
    by = Window.partitionBy("dedup_hash")
    ranked = chunks.withColumn("dedup_hash", dedup_hash(chunks))
    return ranked.withColumn("group_size", F.count(F.lit(1)).over(by)).withColumn("is_representative", F.row_number().over(by.orderBy(order)) == 1)


def dedup_stats(chunks: DataFrame) -> DataFrame:
    """total_chunks, unique_count, duplicate_count; by partial counts of a hash a row."""
    hashed = chunks.select(dedup_hash(chunks).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return hashed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"), F.count(F.lit(1)).alias("unique_count")).withColumn("duplicate_count", F.col("total_chunks") - F.col("unique_count"))


def dedup_expand(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Gives what was made for representatives (by dedup_hash) to all chunks of their groups."""
    return chunks.withColumn("dedup_hash", dedup_hash(chunks)).join(results, "dedup_hash", "left")


def line_stats(text: Column) -> dict[str, Column]:
    """lines, max_line, mean_line, space_ratio; a final line end begins no line."""
    body = F.regexp_replace(text, "\r?\n$", "")
    sizes = F.transform(F.split(body, "\r?\n"), F.length)
    n = F.when(F.length(text) == 0, 0).otherwise(F.size(sizes))
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    spaces = F.length(text) - F.length(F.regexp_replace(text, r"\s", ""))
    return {"lines": n, "max_line": F.array_max(sizes), "mean_line": total / F.greatest(n, F.lit(1)), "space_ratio": spaces / F.greatest(F.length(text), F.lit(1))}


def minified(text: Column, *, max_line: int = MAX_LINE, mean_line: int = MEAN_LINE) -> Column:
    """One very long line, or few lines that are long on average, or few long lines almost without white space."""
    s = line_stats(text)
    flag = (s["max_line"] >= max_line) | ((s["lines"] <= 6) & (s["mean_line"] >= mean_line)) | ((s["lines"] <= 3) & (s["space_ratio"] < 0.04) & (s["mean_line"] > 120))
    return F.when(F.length(text) == 0, False).otherwise(flag)


def quality(df: DataFrame, text: str = "source") -> Column:
    """Size, lines, share of letters and of signs, and what is known about the symbol."""
    t = F.col(text)
    n = F.greatest(F.length(t), F.lit(1))
    letters = F.length(t) - F.length(F.regexp_replace(t, r"\p{L}", ""))
    signs = F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]", ""))
    lines = F.greatest(line_stats(t)["lines"], F.lit(1))
    score = F.least(F.octet_length(t) / 500.0, F.lit(12.0)) + F.least(lines / 20.0, F.lit(6.0)) + letters / n * 6.0 + (F.lit(1.0) - F.least(signs / n, F.lit(1.0))) * 2.5
    kind = _opt(df, "symbol_kind")
    return score + F.when(_opt(df, "signature") != "", 1.5).otherwise(0.0) + F.when(_opt(df, "docstring") != "", 1.0).otherwise(0.0) + F.when((kind != "") & (kind != "file"), 0.8).otherwise(0.0)


def judged(chunks: DataFrame, *, text: str = "source", file: str = "file_path", order: str = "chunk_id", min_bytes: int = MIN_BYTES, skip_minified: bool = True, per_file: int = PER_FILE) -> DataFrame:
    """Chunks with verdict: small, minified, capped (beyond the best per_file of a file, ties by `order`) or kept."""
    t = F.col(text)
    first = F.when(F.octet_length(F.coalesce(t, F.lit(""))) < min_bytes, "small")
    if skip_minified:
        first = first.when(minified(t), "minified")
    rated = chunks.withColumn("verdict", first.otherwise("kept")).withColumn("quality", quality(chunks, text))
    rank = F.row_number().over(Window.partitionBy(file, "verdict").orderBy(F.desc("quality"), order))
    return rated.withColumn("verdict", F.when((F.col("verdict") == "kept") & (rank > per_file), "capped").otherwise(F.col("verdict")))


def filter_chunks(chunks: DataFrame, **settings) -> DataFrame:
    return judged(chunks, **settings).where("verdict = 'kept'").drop("verdict")


def filter_stats(chunks: DataFrame, *, file: str = "file_path", **settings) -> DataFrame:
    """One row: input_chunks, kept_chunks, skipped_small, skipped_minified, skipped_per_file_cap, files_capped."""
    found = judged(chunks, file=file, **settings)
    n = lambda v: F.count_if(F.col("verdict") == v)
    return found.agg(
        F.count(F.lit(1)).alias("input_chunks"),
        n("kept").alias("kept_chunks"),
        n("small").alias("skipped_small"),
        n("minified").alias("skipped_minified"),
        n("capped").alias("skipped_per_file_cap"),
        F.countDistinct(F.when(F.col("verdict") == "capped", F.col(file))).alias("files_capped"),
    )


def global_cap(chunks: DataFrame, most: int = TOTAL, *, text: str = "source", order: str = "chunk_id") -> DataFrame:
    """The `most` longest; a top-k, so no full sort."""
    return chunks.orderBy(F.desc(F.length(text)), order).limit(most)


def truncated(text: Column, most: int = MAX_BYTES) -> Column:
    """At most so many bytes, whole characters, with a mark where something was cut."""
    mark = "\n... [truncated]"
    cut = F.decode(F.substring(F.encode(text, "UTF-8"), 1, most - len(mark)), "UTF-8")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.regexp_replace(cut, "�+$", ""), F.lit(mark)))


def description(df: DataFrame) -> Column:
    """The docstring's first sentence, or kind, name, parent and place put into words."""
    doc = _opt(df, "docstring")
    sentence = F.trim(F.regexp_extract(doc, r"(?s)^\s*(.*?[.!?])(?:\s|$)", 1))
    first = F.when(sentence != "", sentence).otherwise(F.trim(F.substring_index(F.trim(doc), "\n", 1)))
    parent, signature = _opt(df, "parent"), _opt(df, "signature")
    composed = F.concat(F.initcap(F.replace(F.col("symbol_kind"), F.lit("_"), F.lit(" "))), F.lit(" "), F.col("symbol_name"), F.when(parent != "", F.concat(F.lit(" of "), parent)).otherwise(""), F.lit(" in "), F.substring_index(F.col("file_path"), "/", -1), F.when(signature != "", F.concat(F.lit(": "), signature)).otherwise(""))
    return F.when(first != "", first).otherwise(composed)


def description_keywords(df: DataFrame, most: int = 10) -> Column:
    text = F.concat_ws(" ", F.array_join(F.transform(T.split_word(F.regexp_replace("symbol_name", r"[^\p{L}\p{N}_]", "_")), lambda x: x), " "), _opt(df, "parent"), _opt(df, "docstring"), _opt(df, "signature"))
    return T.keywords(text, most)


def artifact_bundle(path: str | Column) -> Column:
    """Whether a path's name looks like that of a built bundle."""
    name = F.lower(F.substring_index(F.col(path) if isinstance(path, str) else path, "/", -1))
    return name.rlike(r"(\.min\.|\.bundle\.|\.chunk\.|-[0-9a-f]{8,}\.|^(chunk|vendor|bundle)[.-])")


def artifact_profile(text: Column, path: Column) -> dict[str, Column]:
    """Line statistics, whether the name looks like a bundle's, and whether the content looks minified."""
    s = line_stats(text)
    return s | {"bundle_name": artifact_bundle(path), "minified": minified(text)}


def artifact_downgrade(text: Column, path: Column, language: Column) -> Column:
    """Whether a script should be indexed as one artifact rather than by its symbols: by size and lines."""
    s, n = artifact_profile(text, path), F.octet_length(text)
    big = (n >= 512 * 1024) | ((n >= 256 * 1024) & (s["minified"] | s["bundle_name"])) | ((n >= 192 * 1024) & s["minified"] & s["bundle_name"])
    return language.isin("javascript", "typescript", "tsx") & big
