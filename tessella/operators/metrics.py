"""Slices: shared years, weights, headline aggregates, coverage, ranks and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.columns import finite

from .order import numbered
from .panel import SERIES, SLICE


def shared_years(panel: DataFrame, pairs: DataFrame) -> DataFrame:
    """(geo, indicator, weight, year) present in both; all of the indicator's if none is shared.

    `is_default` marks the latest.
    """
    years = panel.where(finite("value")).select(*SLICE).distinct()
    of_weight = years.withColumnRenamed("indicator", "weight").withColumn("_both", F.lit(1))
    both = pairs.join(years, ["geo", "indicator"]).join(of_weight, ["geo", "weight", "year"], "left")
    per = W.partitionBy("geo", "indicator", "weight")
    out = both.withColumn("_any", F.max("_both").over(per)).where("_both = 1 or _any is null")
    return out.withColumn("is_default", F.col("year") == F.max("year").over(per)).select("geo", "indicator", "weight", "year", "is_default")


def weight_slice(panel: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (geo, weight, year): the weight's values of that year, or of its last year at
    all if it has none; the year is chosen for the slice, not for a region."""
    values = panel.where(finite("value")).withColumnRenamed("indicator", "weight")
    years = values.select("geo", "weight", F.col("year").alias("weight_year")).distinct()
    last = years.groupBy("geo", "weight").agg(F.max("weight_year").alias("_last"))
    exact = years.withColumn("year", F.col("weight_year"))
    chosen = wanted.select("geo", "weight", "year").distinct().join(exact, ["geo", "weight", "year"], "left").join(last, ["geo", "weight"])
    chosen = chosen.withColumn("weight_year", F.coalesce("weight_year", "_last")).drop("_last")
    return chosen.join(values.withColumnRenamed("year", "weight_year"), ["geo", "weight", "weight_year"]).withColumnRenamed("value", "w")


def headline(values: DataFrame, weights: DataFrame, indicator: DataFrame) -> DataFrame:
    """values ⋈ weights (geo, year, region_id, w): the sum of counts, else the mean weighted by
    w, 1 where the weight is missing. A slice without a finite value has the label "no data" and no
    value; a mean whose weights are not positive in all keeps its label and has no value."""
    rows = values.join(weights.select("geo", "year", "region_id", "w"), ["geo", "year", "region_id"], "left")
    v = F.when(finite("value"), F.col("value"))
    w = F.when(v.isNotNull(), F.coalesce(F.when(finite("w"), F.col("w")), F.lit(1.0)))
    weighted = F.count(F.when(v.isNotNull(), F.col("w")))
    sums = rows.groupBy(*SLICE).agg(F.sum(v).alias("_sum"), F.sum(v * w).alias("_vw"), F.sum(w).alias("_w"), weighted.alias("_n"), F.count(v).alias("_have"))
    out = sums.join(indicator.select("geo", "indicator", "kind"), ["geo", "indicator"])
    value = F.when(F.col("kind") == "count", F.col("_sum")).when(F.col("_w") > 0, F.col("_vw") / F.col("_w"))
    label = F.when(F.col("_have") == 0, "no data").when(F.col("kind") == "count", "Total").when(F.col("_n") > 0, "weighted mean").otherwise("mean")
    return out.select(*SLICE, value.alias("value"), label.alias("label"))


def coverage(panel: DataFrame, n_regions: DataFrame) -> DataFrame:
    have = panel.groupBy(*SLICE).agg(F.count_if(finite("value")).alias("have"))
    return have.join(n_regions, "geo").withColumn("share", F.col("have") / F.col("n_regions"))


def rank_regions(panel: DataFrame) -> DataFrame:
    """Position among finite values of a slice, largest first, ties by region, and their number."""
    return numbered(panel.where(finite("value")), SLICE, [F.col("value").desc(), F.col("region_id")], "pos", "n")


def top_k(panel: DataFrame, region: DataFrame, k: int = 22) -> DataFrame:
    """The first k of each slice with their labels, and how many there are in all."""
    points = panel.where(finite("value"))
    order = W.partitionBy(*SLICE).orderBy(F.col("value").desc(), "region_id")
    first = points.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)  # pruned before the shuffle
    sizes = points.groupBy(*SLICE).agg(F.count("*").alias("n"))
    named = first.join(sizes, SLICE).join(region.select("geo", "region_id", F.col("label").alias("_label")), ["geo", "region_id"], "left")
    return named.select(*SLICE, "pos", "region_id", F.coalesce("_label", "region_id").alias("label"), "value", "n")


def latest_year(panel: DataFrame) -> DataFrame:
    return panel.where(finite("value")).groupBy("geo", "indicator").agg(F.max("year").alias("year"))


def top_by_latest_weight(panel: DataFrame, region: DataFrame, weight: str, k: int = 24, highlighted: int = 3) -> DataFrame:
    """Regions by a weight's value in its last year, 0 where missing."""
    values = panel.where(F.col("indicator") == weight)
    last = values.join(latest_year(values), SLICE, "left_semi").where(finite("value")).select("geo", "region_id", F.col("value").alias("weight"))
    rows = region.join(last, ["geo", "region_id"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    pos = F.row_number().over(W.partitionBy("geo").orderBy(F.col("weight").desc(), "region_id"))
    return rows.withColumn("pos", pos).where(F.col("pos") <= k).select("geo", "region_id", "label", "weight", "pos", (F.col("pos") <= highlighted).alias("highlighted"))


def value_table(region: DataFrame, values: DataFrame, weights: DataFrame) -> DataFrame:
    """Every labelled region of each slice with its value and weight, numbered by value,
    missing ones last."""
    slices = values.select(*SLICE).distinct()
    rows = slices.join(region.where("label is not null"), "geo")
    rows = rows.join(values.where(finite("value")), [*SLICE, "region_id"], "left").join(weights.select("geo", "year", "region_id", "w"), ["geo", "year", "region_id"], "left")
    rows = rows.select(*SLICE, "region_id", "label", "value", "w")
    return numbered(rows, SLICE, [F.col("value").desc_nulls_last(), F.col("region_id")], "row")


def missing_regions(region: DataFrame, weights: DataFrame) -> DataFrame:
    """Regions without a positive weight, for each slice of weights (geo, weight, year)."""
    slices = weights.select("geo", "weight", "year").distinct()
    good = weights.where(finite("w") & (F.col("w") > 0))
    return slices.join(region.select("geo", "region_id"), "geo").join(good, ["geo", "weight", "year", "region_id"], "left_anti")


def weight_share(weights: DataFrame, total_tiles: int) -> DataFrame:
    """Total of a map's positive weights, each region's share, and what a tile stands for."""
    good = weights.where(finite("w") & (F.col("w") > 0))
    total = good.groupBy("map_id").agg(F.sum("w").alias("total"))
    rows = good.join(total, "map_id")
    return rows.select("map_id", "region_id", "w", "total", (F.col("w") / F.col("total")).alias("share"), (F.col("total") / total_tiles).alias("per_tile"))


def series_last_point(panel: DataFrame) -> DataFrame:
    points = panel.where(finite("value"))
    return points.groupBy(*SERIES).agg(F.max("year").alias("year"), F.max_by("value", "year").alias("value"))
