"""Data-quality checks; each gives rows problem(check, geo, indicator, year, region_id, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import finite

from .panel import SLICE
from .trend import choose_base_year

#: What a descriptor must have, and the kinds.
FIELDS = {"label": "label", "unit": "unit", "kind": "kind", "decimals": "decimals", "source": "source", "source_url": "sourceUrl"}
KINDS = ("count", "rate", "currency", "index")
COLUMNS = ("geo", "indicator", "year", "region_id")


def _problem(rows: DataFrame, check: str, detail: Column) -> DataFrame:
    have = {"year": "int"}
    return rows.select(
        F.lit(check).alias("check"), *[F.col(c) if c in rows.columns else F.lit(None).cast(have.get(c, "string")).alias(c) for c in COLUMNS], detail.cast("string").alias("detail")
    )


def missing_fields(indicator: DataFrame) -> DataFrame:
    gone = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(name)) for f, name in FIELDS.items()]))
    rows = indicator.select("geo", "indicator", F.explode(gone).alias("_field"))
    return _problem(rows, "missing field", F.col("_field"))


def unknown_kinds(indicator: DataFrame) -> DataFrame:
    """Kinds that are none of the four; a kind that is not given is one too."""
    rows = indicator.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)))
    return _problem(rows, "unknown kind", F.coalesce("kind", F.lit("missing")))


def unknown_regions(panel: DataFrame, region: DataFrame) -> DataFrame:
    return _problem(panel.join(region, ["geo", "region_id"], "left_anti"), "unknown region", F.col("region_id"))


def non_finite_values(panel: DataFrame) -> DataFrame:
    return _problem(panel.where(~finite("value")), "non-finite value", F.col("value"))


def negative_counts(panel: DataFrame, indicator: DataFrame) -> DataFrame:
    rows = panel.join(indicator.where("kind = 'count'").select("geo", "indicator"), ["geo", "indicator"], "left_semi")
    return _problem(rows.where(finite("value") & (F.col("value") < 0)), "negative count", F.col("value"))


def trend_notes(panel: DataFrame, region: DataFrame, bar: float = 0.9, least: float = 0.85) -> DataFrame:
    """Base year covers too little; else, base year moved; a single year."""
    base = choose_base_year(panel, region, bar)
    few = F.col("base_have") < least * F.col("latest_have")
    moved = _problem(base.where((F.col("base_year") != F.col("first_year")) & ~few).withColumn("year", F.col("base_year")), "base year moved", F.col("first_year"))
    thin = _problem(base.where(few).withColumn("year", F.col("base_year")), "base year covers too little", F.col("base_have"))
    single = _problem(base.where("n_years = 1").withColumn("year", F.col("base_year")), "single year", F.col("n_years"))
    return moved.unionByName(thin).unionByName(single)


def no_shared_year(panel: DataFrame, pairs: DataFrame) -> DataFrame:
    years = panel.where(finite("value")).select(*SLICE).distinct()
    shared = years.join(years.withColumnRenamed("indicator", "weight"), ["geo", "year"])
    return _problem(pairs.join(shared, ["geo", "indicator", "weight"], "left_anti"), "no shared year", F.col("weight"))


def map_gates(measures: DataFrame) -> DataFrame:
    """measures(map_id, geo, mean_error, cells, budget, regions, fragmented) of each map -> what
    fails: a mean error above 5 %, under 97 % of the tiles, over 15 % of the regions in pieces."""
    detail = lambda pattern, *c: F.format_string(pattern, "map_id", *c).alias("d")
    rows = measures.select(
        "geo",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("mean_error") > 5, F.struct(F.lit("allocation error").alias("c"), detail("%s|%.1f", "mean_error"))),
                    F.when(F.col("cells") < 0.97 * F.col("budget"), F.struct(F.lit("tiles missing").alias("c"), detail("%s|%d/%d", "cells", "budget"))),
                    F.when(F.col("fragmented") > 0.15 * F.col("regions"), F.struct(F.lit("fragmented").alias("c"), detail("%s|%d/%d", "fragmented", "regions"))),
                )
            )
        ).alias("_p"),
    )
    return rows.select(
        F.col("_p.c").alias("check"), "geo", *[F.lit(None).cast(t).alias(n) for n, t in (("indicator", "string"), ("year", "int"), ("region_id", "string"))], F.col("_p.d").alias("detail")
    )
