"""Panels from the star schema, in DataFrames and in SQL.

Coarse: sales regions are geographies, nations their regions, years of orders; five indicators.
Fine: brands are geographies, parts their regions, years of shipping; two indicators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.columns import round_half_up
from tessella.functions.tables import by_merge

#: indicator, label, unit, kind, decimals
COARSE = (
    ("orders", "Orders", "", "count", 0),
    ("revenue", "Revenue", "EUR", "count", 2),
    ("avg_order", "Mean order", "EUR", "currency", 2),
    ("finalised_pct", "Finalised", "%", "rate", 2),
    ("price_index", "Price index", "", "index", 2),
)
FINE = (("qty", "Quantity", "", "count", 0), ("avg_discount", "Mean discount", "", "rate", 4))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coarse_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("r_name").alias("geo"), F.col("n_nationkey").cast("string").alias("region_id"), F.col("n_name").alias("label")
    )


def coarse_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    per = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy(F.col("c_nationkey").cast("string").alias("region_id"), F.year("o_orderdate").alias("year"))
        .agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    )
    # partial sums a nation and year: small, whatever the orders
    per = per.join(coarse_region(spark, sf_dir).select("geo", "region_id"), "region_id")
    means = per.groupBy("geo", "year").agg((F.sum(F.col("total").cast("decimal(20,2)")).cast("double") / F.sum("n")).alias("geo_mean"))
    rows = per.join(means, ["geo", "year"])
    mean = F.col("total") / F.col("n")
    values = {
        "orders": F.col("n").cast("double"),
        "revenue": F.col("total"),
        "avg_order": round_half_up(mean, 2),
        "finalised_pct": round_half_up(100 * F.col("done") / F.col("n"), 2),
        "price_index": round_half_up(100 * mean / F.col("geo_mean"), 2),
    }
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("indicator"), v.alias("value")) for k, v in values.items()]))
    return rows.select("geo", "year", "region_id", stacked.alias("_v")).select("geo", "_v.indicator", "year", "region_id", "_v.value")


def coarse_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indicators(read(spark, sf_dir, "region").select(F.col("r_name").alias("geo")), COARSE)


def _indicators(geos: DataFrame, rows: tuple) -> DataFrame:
    made = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("indicator", "label", "unit", "kind", "decimals"), row, strict=True)]) for row in rows])
    return geos.select("geo", F.inline(made)).withColumn("source", F.lit("orders")).withColumn("source_url", F.lit(""))


def fine_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    per = lines.groupBy(F.col("l_partkey").alias("p_partkey"), F.year("l_shipdate").alias("year")).agg(
        F.sum("l_quantity").alias("qty"), F.sum(F.col("l_discount").cast("decimal(10,2)")).cast("double").alias("_d"), F.count("*").alias("_n")
    )
    rows = per.join(by_merge(part.select("p_partkey", F.col("p_brand").alias("geo"))), "p_partkey")
    made = F.array(F.struct(F.lit("qty").alias("indicator"), F.col("qty").alias("value")), F.struct(F.lit("avg_discount").alias("indicator"), round_half_up(F.col("_d") / F.col("_n"), 4).alias("value")))
    return rows.select("geo", "year", F.col("p_partkey").cast("string").alias("region_id"), F.inline(made)).select("geo", "indicator", "year", "region_id", "value")


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantities of the fine panel alone, for queries that need no other indicator: (p_partkey, year, value) of each part shipped."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_partkey").alias("p_partkey"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("value"))


def fine_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("geo"), F.col("p_partkey").cast("string").alias("region_id"), F.col("p_name").alias("label"))


def fine_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indicators(read(spark, sf_dir, "part").select(F.col("p_brand").alias("geo")).distinct(), FINE)


def r(x: str, d: int) -> str:
    """Half-up rounding in SQL."""
    return f"floor(({x}) * power(10.0, {d}) + 0.5) / power(10.0, {d})"


def _values(rows: tuple) -> str:
    return ", ".join(str(row) for row in rows)


#: Common table expressions that the SQL of all queries may use.
SQL = f"""
region_dim AS (SELECT r_name AS geo, CAST(n_nationkey AS VARCHAR) AS region_id, n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey),
n_regions AS (SELECT geo, count(DISTINCT region_id) AS n_regions FROM region_dim GROUP BY geo),
coarse_per AS (
  SELECT d.geo, CAST(year(o_orderdate) AS INTEGER) AS year, d.region_id, count(*) AS n,
         CAST(sum(CAST(o_totalprice AS DECIMAL(20,2))) AS DOUBLE) AS total, count(*) FILTER (o_orderstatus = 'F') AS done
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN region_dim d ON d.region_id = CAST(c_nationkey AS VARCHAR) GROUP BY 1, 2, 3),
geo_means AS (SELECT geo, year, CAST(sum(CAST(total AS DECIMAL(20,2))) AS DOUBLE) / sum(n) AS geo_mean FROM coarse_per GROUP BY 1, 2),
panel AS (
  SELECT geo, 'orders' AS indicator, year, region_id, CAST(n AS DOUBLE) AS value FROM coarse_per
  UNION ALL SELECT geo, 'revenue', year, region_id, total FROM coarse_per
  UNION ALL SELECT geo, 'avg_order', year, region_id, {r("total / n", 2)} FROM coarse_per
  UNION ALL SELECT geo, 'finalised_pct', year, region_id, {r("CAST(100 * done AS DOUBLE) / n", 2)} FROM coarse_per
  UNION ALL SELECT geo, 'price_index', year, region_id, {r("100 * (total / n) / geo_mean", 2)} FROM coarse_per JOIN geo_means USING (geo, year)),
coarse_kinds(indicator, label, unit, kind, decimals) AS (VALUES {_values(COARSE)}),
indicator_dim AS (SELECT r_name AS geo, k.*, 'orders' AS source, '' AS source_url FROM region, coarse_kinds k),
fine_per AS (
  SELECT l_partkey, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS qty, CAST(sum(CAST(l_discount AS DECIMAL(10,2))) AS DOUBLE) AS d, count(*) AS n FROM lineitem GROUP BY 1, 2),
fine AS (
  SELECT p_brand AS geo, 'qty' AS indicator, year, CAST(l_partkey AS VARCHAR) AS region_id, qty AS value FROM fine_per JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT p_brand, 'avg_discount', year, CAST(l_partkey AS VARCHAR), {r("d / n", 4)} FROM fine_per JOIN part ON l_partkey = p_partkey),
fine_region AS (SELECT p_brand AS geo, CAST(p_partkey AS VARCHAR) AS region_id, p_name AS label FROM part),
fine_n AS (SELECT geo, count(DISTINCT region_id) AS n_regions FROM fine_region GROUP BY geo),
fine_kinds(indicator, label, unit, kind, decimals) AS (VALUES {_values(FINE)}),
fine_indicator AS (SELECT g.geo, k.* FROM (SELECT DISTINCT p_brand AS geo FROM part) g, fine_kinds k)
"""
