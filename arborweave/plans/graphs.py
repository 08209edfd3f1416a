"""Graphs derived from the relational tables, as DataFrames and as SQL with the same edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweave.functions.ranking import global_position
from arborweave.sources.edges import adjacency


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and the addresses they link to; addresses are numbered behind the pages in their order."""
    pages = read(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("href"))
    numbered = global_position(links.select("href").distinct(), [F.col("href").asc()], "number").select(F.col("href").alias("__href"), "number")
    offset = pages.count()
    return links.join(numbered, F.col("href") == F.col("__href")).select(F.col("page_id").cast("long").alias("src"), (F.col("number") + offset).alias("dst"))


def events_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and the number in their events' properties, behind the largest user."""
    events = read(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k")).filter("user_id IS NOT NULL AND k IS NOT NULL")
    top = events.agg(F.max("user_id")).first()[0] or 0
    return events.select(F.col("user_id").alias("src"), (F.col("k") + top + 1).alias("dst"))


def cust_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the parts that they ordered, parts behind the customers."""
    offset = read(spark, sf_dir, "customer").count()
    orders, items = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_partkey") + offset).alias("dst"))


def supp_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share an order, as often as they do. Lines are shuffled once, for distinct ones and for both sides of the join."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").repartition("l_orderkey").distinct()
    a, b = items.alias("a"), items.alias("b")
    return a.join(b, F.col("a.l_orderkey") == F.col("b.l_orderkey")).filter("a.l_suppkey < b.l_suppkey").select(F.col("a.l_suppkey").alias("src"), F.col("b.l_suppkey").alias("dst"))


def lineitem_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers of line items, numbers of both taken as one kind of id."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


GRAPHS = {f.__name__: f for f in (page_link, events_k, cust_part, supp_pair, lineitem_pair)}


def edges(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """src, dst of the graph's edges in any direction, as often as the tables have them, with self-loops."""
    return GRAPHS[name](spark, sf_dir)


def graph(spark: SparkSession, sf_dir: str, name: str, directed: bool = False) -> DataFrame:
    return adjacency(edges(spark, sf_dir, name), directed)


EDGE_SQL = {
    "page_link": """
        SELECT page_id AS src, (SELECT count(*) FROM pages) + dense_rank() OVER (ORDER BY href) - 1 AS dst
        FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)""",
    "events_k": """
        SELECT user_id AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) + (SELECT max(user_id) FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL) + 1 AS dst
        FROM events WHERE user_id IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL""",
    "cust_part": """
        SELECT o_custkey AS src, l_partkey + (SELECT count(*) FROM customer) AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "supp_pair": """
        SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey""",
    "lineitem_pair": "SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem",
}


def adjacency_sql(name: str, directed: bool = False) -> str:
    """Common table expressions: edges, and adj (src, dst)."""
    both = "" if directed else " UNION ALL SELECT dst, src FROM edges"
    return f"edges AS ({EDGE_SQL[name]}\n), adj AS MATERIALIZED (SELECT DISTINCT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM (SELECT src, dst FROM edges{both}) WHERE src <> dst)"
