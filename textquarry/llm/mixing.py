"""Mixing sources to target weights under a maximum number of epochs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import fresh, key_string, unit, unit_sql

#: Target weights by source; any other source has DEFAULT_WEIGHT.
WEIGHTS: dict[str, float] = {"src0": 8.0, "src1": 6.0, "src2": 4.0}
DEFAULT_WEIGHT, MAX_EPOCHS, BUDGET, SEED = 1.0, 3.0, 1.0, 17
#: The plan is broadcast when it has no more sources than this; else the join shuffles.
BROADCAST_SOURCES = 10_000


def plan(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, *, default_weight: float = DEFAULT_WEIGHT, max_epochs: float = MAX_EPOCHS, budget: float = BUDGET, text: str = "text", source: str = "source") -> DataFrame:
    """Of each source its characters (size), weight, cap = size * max_epochs and epochs, by capped water-filling.

    The budget is a multiple of all characters. Sources whose proportional share exceeds their cap are clamped to it and
    the excess goes to the others in proportion to their weights, again and again until no share exceeds its cap. That
    fixed point is found at once: with sources ordered by cap / weight, those are clamped at whose level the filled
    amount is still within the budget. If all caps together are less than the budget, all are clamped.
    Sources of other types than strings go by their string. A null source is a source of its own; a source without characters has 1 epoch; weight 0 or less gives 0 epochs.
    """
    sizes = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("long").alias("size"))
    weight = F.lit(float(default_weight))
    if weights:
        table = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])
        weight = F.coalesce(F.when(F.col("source").isNotNull(), F.element_at(table, F.col("source"))), weight)
    everything, below = Window.partitionBy(), Window.partitionBy().orderBy("level").rangeBetween(Window.unboundedPreceding, 0)
    rated = sizes.withColumn("weight", F.greatest(weight, F.lit(0.0))).withColumn("cap", F.col("size") * F.lit(float(max_epochs)))
    leveled = rated.withColumn("level", F.when((F.col("weight") > 0) & (F.col("size") > 0), F.col("cap") / F.col("weight")))
    filled = F.sum("cap").over(below) + F.col("level") * (F.sum("weight").over(everything) - F.sum("weight").over(below))
    live = (
        leveled.withColumn("total", F.sum("size").over(everything) * F.lit(float(budget)))
        .where(F.col("level").isNotNull())
        .withColumn("clamped", filled <= F.col("total"))
    )
    capped = F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(everything), F.lit(0.0))
    free = F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(everything)
    share = F.when(F.col("clamped"), F.col("cap")).otherwise((F.col("total") - capped) * F.col("weight") / free)
    done = live.withColumn("epochs", F.least(share / F.col("size"), F.lit(float(max_epochs)))).select("source", "size", "weight", "epochs")
    rest = leveled.where(F.col("level").isNull()).withColumn("epochs", F.when(F.col("weight") > 0, 1.0).otherwise(0.0)).select("source", "size", "weight", "epochs")
    return done.unionByName(rest)


def mix(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, *, default_weight: float = DEFAULT_WEIGHT, max_epochs: float = MAX_EPOCHS, budget: float = BUDGET, seed: int = SEED, text: str = "text", source: str = "source", key: str = "doc_id", copy: str | None = None) -> DataFrame:
    """Every document floor(epochs) times, and once more if a seeded hash of its key is below the fraction.

    The columns stay as they are; `copy` names one more for the number of the repetition (a column of that name is
    replaced; others may have any names). Equal keys, and all null keys, get the same draw; repeated rows are each
    repeated. Null and empty texts count no characters, long ones all of theirs; a source of such texts alone has 1
    epoch. An empty table stays empty. Only the plan, a row a source, is moved.
    """
    spark = docs.sparkSession
    made = plan(docs, weights, default_weight=default_weight, max_epochs=max_epochs, budget=budget, text=text, source=source)
    rows = made.limit(BROADCAST_SOURCES + 1).collect()
    if len(rows) <= BROADCAST_SOURCES:
        made = F.broadcast(spark.createDataFrame([tuple(r) for r in rows], "source string, size long, weight double, epochs double"))
    src, epochs, number = fresh(docs.columns, "mix_source", "mix_epochs", "mix_copy")
    made = made.select(F.col("source").alias(src), F.col("epochs").alias(epochs))
    draw = unit(F.lit(str(seed)), key_string(key))
    copies = F.floor(epochs) + F.when(draw < F.col(epochs) - F.floor(epochs), 1).otherwise(0)
    joined = docs.join(made, docs[source].cast("string").eqNullSafe(made[src]), "inner").withColumn(number, copies.cast("int"))
    columns = [F.col(f"`{c}`") for c in docs.columns if copy is None or c.lower() != copy.lower()]
    repeated = joined.where(F.col(number) > 0).withColumn(number, F.explode(F.sequence(F.lit(0), F.col(number) - 1)))
    return repeated.select(*columns, *([F.col(number).alias(copy)] if copy else []))


def mix_sql(table: str, columns: str, weights: Mapping[str, float] = WEIGHTS, *, default_weight: float = DEFAULT_WEIGHT, max_epochs: float = MAX_EPOCHS, budget: float = BUDGET, seed: int = SEED) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {float(w)!r}::DOUBLE" for k, w in weights.items())
    return f"""
WITH sizes AS (SELECT source, coalesce(sum(length(text)), 0)::BIGINT AS size FROM {table} GROUP BY source),
rated AS (SELECT source, size, greatest(CASE source {cases} ELSE {float(default_weight)!r}::DOUBLE END, 0::DOUBLE) AS weight, size * {float(max_epochs)!r}::DOUBLE AS cap FROM sizes),
level AS (SELECT *, CASE WHEN weight > 0 AND size > 0 THEN cap / weight END AS level, (SELECT sum(size) FROM sizes)::DOUBLE * {float(budget)!r}::DOUBLE AS total FROM rated),
live AS (SELECT *, sum(cap) OVER b + level * (sum(weight) OVER () - sum(weight) OVER b) <= total AS clamped FROM level WHERE level IS NOT NULL WINDOW b AS (ORDER BY level RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
filled AS (SELECT source, least(CASE WHEN clamped THEN cap ELSE (total - coalesce(sum(cap) FILTER (WHERE clamped) OVER (), 0)) * weight / (sum(weight) FILTER (WHERE NOT clamped) OVER ()) END / size, {float(max_epochs)!r}::DOUBLE) AS epochs FROM live
  UNION ALL SELECT source, CASE WHEN weight > 0 THEN 1.0 ELSE 0.0 END FROM level WHERE level IS NULL),
counted AS (SELECT d.*, (floor(f.epochs) + CASE WHEN {unit_sql(f"'{seed}'", "coalesce(d.doc_id::VARCHAR, '\\N')")} < f.epochs - floor(f.epochs) THEN 1 ELSE 0 END)::INTEGER AS copies
  FROM {table} d JOIN filled f ON d.source IS NOT DISTINCT FROM f.source)
SELECT {columns} FROM (SELECT *, unnest(range(copies))::INTEGER AS copy FROM counted)"""
