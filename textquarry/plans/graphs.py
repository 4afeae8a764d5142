"""Queries over graphs: links, degrees, traces, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.operators import graphs as G
from textquarry.plans.registry import query, table

LINKS = "l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) - 1 AS pos FROM pages)"


@query(f"WITH {LINKS} SELECT page_id, pos::INTEGER AS pos, href FROM l")
def link_extract(spark: SparkSession, folder: str) -> DataFrame:
    return G.links(table(spark, folder, "pages"))


@query(f"WITH {LINKS} SELECT a.page_id, b.page_id AS other_id, count(DISTINCT href) AS shared FROM (SELECT DISTINCT page_id, href FROM l) a JOIN (SELECT DISTINCT page_id, href FROM l) b USING (href) WHERE a.page_id % 50 = 0 AND a.page_id <> b.page_id GROUP BY ALL HAVING count(DISTINCT href) >= 2")
def link_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that share two or more link targets with one of the pages asked for: those whose id is divisible by 50."""
    links = G.links(table(spark, folder, "pages")).select("page_id", "href")
    return G.sharing(links, links.where("page_id % 50 = 0"), least=2)


@query(f"WITH {LINKS}, e AS (SELECT DISTINCT page_id::VARCHAR AS src, href AS dst FROM l), n AS (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM n GROUP BY node")
def graph_degree(spark: SparkSession, folder: str) -> DataFrame:
    return G.degrees(G.links(table(spark, folder, "pages")).select(F.col("page_id").cast("string").alias("src"), F.col("href").alias("dst")))


@query(f"WITH {LINKS} SELECT href, count(*) AS sites, count(DISTINCT page_id) AS callers, min(page_id) AS first_caller FROM l GROUP BY href")
def callers_of(spark: SparkSession, folder: str) -> DataFrame:
    """Who links to each target."""
    return G.links(table(spark, folder, "pages")).groupBy("href").agg(F.count(F.lit(1)).alias("sites"), F.countDistinct("page_id").alias("callers"), F.min("page_id").alias("first_caller"))


EDGES = """e AS (SELECT concat('c', c_custkey) AS src, concat('n', c_nationkey) AS dst FROM customer UNION SELECT concat('s', s_suppkey), concat('n', s_nationkey) FROM supplier
UNION SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation UNION SELECT concat('o', o_orderkey), concat('c', o_custkey) FROM orders)"""


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Orders lead to customers, customers and suppliers to nations, nations to regions."""
    out = None
    for name, a, x, b, y in (("orders", "o", "o_orderkey", "c", "o_custkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey")):
        part = table(spark, folder, name).select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH RECURSIVE {EDGES}, t AS (SELECT concat('r', r_regionkey) AS node, 0 AS level FROM region WHERE r_name = 'ASIA' UNION SELECT e.src, t.level + 1 FROM t JOIN e ON e.dst = t.node WHERE t.level < 5) SELECT node, min(level)::INTEGER AS level FROM t GROUP BY node")
def bfs_trace(spark: SparkSession, folder: str) -> DataFrame:
    """All that leads to one region, with the number of steps."""
    start = table(spark, folder, "region").where("r_name = 'ASIA'").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"))
    return G.trace(spark, edges(spark, folder), start, depth=5, direction="upstream")


@query(f"WITH {EDGES}, p AS (SELECT a.src, c.dst AS region FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src) SELECT region, count(*) AS n FROM p GROUP BY region")
def trace_roots(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of three steps by where they end."""
    e = edges(spark, folder).distinct()
    b, c = e.select(F.col("src").alias("dst"), F.col("dst").alias("d2")), e.select(F.col("src").alias("d2"), F.col("dst").alias("region"))
    return e.join(b, "dst").join(c, "d2").groupBy("region").agg(F.count(F.lit(1)).alias("n"))


STEPS = "t AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), e AS (SELECT DISTINCT src, dst FROM t WHERE dst IS NOT NULL)"


@query(f"""WITH {STEPS} SELECT 1 AS length, src AS nodes FROM e WHERE src = dst
UNION ALL SELECT 2, a.src || '>' || b.src FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < b.src
UNION ALL SELECT 3, a.src || '>' || b.src || '>' || c.src FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < b.src AND a.src < c.src AND b.src <> c.src""")
def cycle_detect(spark: SparkSession, folder: str) -> DataFrame:
    """Cycles of up to three kinds of events that follow one another."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, folder, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst")).where("dst IS NOT NULL")
    return G.cycles(steps, 3).select("length", F.array_join("nodes", ">").alias("nodes"))
