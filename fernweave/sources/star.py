"""The property graph over the star schema, and the same in DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.graph import Graph


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(kind: str, column: str) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers, suppliers, parts and orders as nodes; the community is the nation."""
    t = {n: load(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders")}
    place = t["nation"].join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
    place = F.broadcast(place.select("n_nationkey", "n_name", "r_name"))  # 25 rows
    nation = F.col("n_nationkey").cast("string")

    def rows(df: DataFrame, kind: str, id_: str, label: F.Column, repo: F.Column, file: F.Column, community: F.Column) -> DataFrame:
        return df.select(key(kind, id_).alias("id"), label.alias("label"), F.lit(kind).alias("type"), file.alias("source_file"), repo.alias("repo"), community.cast("string").alias("community"))

    c, none, repo, base = F.col, F.lit(None).cast("string"), F.col("r_name"), F.concat_ws("/", "r_name", "n_name")
    customers = t["customer"].join(place, c("c_nationkey") == c("n_nationkey"))
    orders = t["orders"].select("o_orderkey", "o_custkey").join(customers.select("c_custkey", "n_nationkey", "n_name", "r_name"), c("o_custkey") == c("c_custkey"))
    parts = [
        rows(t["region"], "region", "r_regionkey", repo, repo, repo, none),
        rows(place, "nation", "n_nationkey", c("n_name"), repo, base, nation),
        rows(customers, "customer", "c_custkey", c("c_name"), repo, F.concat_ws("/", base, "c_name"), nation),
        rows(t["supplier"].join(place, c("s_nationkey") == c("n_nationkey")), "supplier", "s_suppkey", c("s_name"), repo, F.concat_ws("/", base, "s_name"), nation),
        rows(t["part"], "part", "p_partkey", c("p_name"), none, F.concat_ws("/", "p_brand", "p_type", "p_name"), none),
        rows(orders, "order", "o_orderkey", F.concat(F.lit("Order#"), c("o_orderkey").cast("string")), repo, F.concat_ws("/", base, F.lit("orders"), c("o_orderkey").cast("string")), nation),
    ]
    return reduce(DataFrame.unionAll, parts).withColumns({"properties": F.lit(None).cast("string"), "ord": F.lit(None).cast("long")})


def star_edges(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """contains, calls, imports, imports_from and references edges. With repeats, an order's edge to a part or supplier comes once for each of its lines."""
    t = lambda n: load(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")

    def rows(df: DataFrame, a: tuple[str, str], b: tuple[str, str], kind: str) -> DataFrame:
        return df.select(key(*a).alias("src"), key(*b).alias("dst"), F.lit(kind).alias("type"))

    pairs = lambda x, y: lines.select(x, y) if repeats and x == "l_orderkey" else lines.select(x, y).distinct()
    parts = [
        rows(t("nation"), ("region", "n_regionkey"), ("nation", "n_nationkey"), "contains"),
        rows(t("customer"), ("nation", "c_nationkey"), ("customer", "c_custkey"), "contains"),
        rows(t("supplier"), ("nation", "s_nationkey"), ("supplier", "s_suppkey"), "contains"),
        rows(t("orders"), ("customer", "o_custkey"), ("order", "o_orderkey"), "calls"),
        rows(pairs("l_orderkey", "l_partkey"), ("order", "l_orderkey"), ("part", "l_partkey"), "imports"),
        rows(pairs("l_partkey", "l_suppkey"), ("part", "l_partkey"), ("supplier", "l_suppkey"), "imports_from"),
        rows(pairs("l_orderkey", "l_suppkey"), ("order", "l_orderkey"), ("supplier", "l_suppkey"), "references"),
    ]
    return reduce(DataFrame.unionAll, parts).withColumns({"confidence": F.lit(None).cast("double"), "ord": F.lit(None).cast("long")})


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(star_nodes(spark, sf_dir), star_edges(spark, sf_dir))


def star_graph_with_repeats(spark: SparkSession, sf_dir: str) -> Graph:
    """For operators to which repeated edges are one."""
    return Graph(star_nodes(spark, sf_dir), star_edges(spark, sf_dir, repeats=True))


STAR_SQL = """
place AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS label, 'region' AS type, r_name AS source_file, r_name AS repo, NULL::VARCHAR AS community FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation', r_name || '/' || n_name, r_name, n_nationkey::VARCHAR FROM place
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer', r_name || '/' || n_name || '/' || c_name, r_name, n_nationkey::VARCHAR FROM customer JOIN place ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier', r_name || '/' || n_name || '/' || s_name, r_name, n_nationkey::VARCHAR FROM supplier JOIN place ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'part', p_brand || '/' || p_type || '/' || p_name, NULL, NULL FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'Order#' || o_orderkey, 'order', r_name || '/' || n_name || '/orders/' || o_orderkey, r_name, n_nationkey::VARCHAR
            FROM orders JOIN customer ON o_custkey = c_custkey JOIN place ON c_nationkey = n_nationkey
),
edges AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'contains' AS type FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains' FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains' FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'calls' FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'imports' FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'imports_from' FROM lineitem
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'references' FROM lineitem
),
ends AS (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges),
degrees AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM ends GROUP BY id),
full_nodes AS (
  SELECT n.*, coalesce(d.in_degree, 0) AS in_degree, coalesce(d.out_degree, 0) AS out_degree,
         coalesce(d.in_degree, 0) * coalesce(d.out_degree, 0) / (SELECT count(*) FROM edges)::DOUBLE AS betweenness
  FROM nodes n LEFT JOIN degrees d USING (id)
)
"""
