"""Trends: base years that cover enough regions, series indexed to them, plot domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.columns import finite

from .panel import SERIES, SLICE


def choose_base_year(panel: DataFrame, region: DataFrame, bar: float = 0.9) -> DataFrame:
    """The first year that has at least `bar` of the labelled regions that the last one has;
    the first year if the last has none."""
    labelled = region.where("label is not null").select("geo", "region_id", F.lit(1).alias("_labelled"))
    rows = panel.join(labelled, ["geo", "region_id"], "left")
    years = rows.groupBy(*SLICE).agg(F.count_if(finite("value") & F.col("_labelled").isNotNull()).alias("have"))
    per = W.partitionBy("geo", "indicator")
    years = years.withColumn("_latest", F.max_by("have", "year").over(per))
    ok = F.when(F.col("_latest") == 0, True).otherwise(F.col("have") >= bar * F.col("_latest"))
    return years.groupBy("geo", "indicator").agg(
        F.min(F.when(ok, F.col("year"))).alias("base_year"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.max("_latest").alias("latest_have"), F.min_by("have", F.when(ok, F.col("year"))).alias("base_have"), F.count("*").alias("n_years"),
    )


def index_to_base(panel: DataFrame, base: DataFrame | None, indexed: bool = True, region: DataFrame | None = None) -> DataFrame:
    """Years from the base on, as per cent of the base year's value; regions without one go,
    and so do those without a label, where `region` is given.

    With indexed=False the values as they are, from the first year on. A base of 0 gives null.
    """
    points = panel.where(finite("value"))
    if region is not None:
        points = points.join(region.where("label is not null").select("geo", "region_id"), ["geo", "region_id"], "left_semi")
    if not indexed:
        return points.select(*SERIES, "year", "value")
    rows = points.join(base.select("geo", "indicator", "base_year"), ["geo", "indicator"]).where("year >= base_year")
    at_base = F.max(F.when(F.col("year") == F.col("base_year"), F.col("value"))).over(W.partitionBy(*SERIES))
    rows = rows.withColumn("_base", at_base).where("_base is not null")
    return rows.select(*SERIES, "year", (F.try_divide("value", "_base") * 100).alias("value"))


def trend_domain(series: DataFrame) -> DataFrame:
    return series.where(finite("value")).groupBy("geo", "indicator").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )


def trend_coverage(series: DataFrame, n_regions: DataFrame) -> DataFrame:
    """Regions that have a line: a series of more than one point."""
    lines = series.groupBy(*SERIES).agg(F.count("*").alias("_n")).where("_n > 1")
    kept = lines.groupBy("geo", "indicator").agg(F.count("*").alias("kept"))
    return kept.join(n_regions, "geo").select("geo", "indicator", "kept", "n_regions")


def series_arrays(series: DataFrame) -> DataFrame:
    """One row a series, its points in order of year; for output only."""
    return series.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("year", "value"))).alias("points"))
