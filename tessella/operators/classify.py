"""Classes of a slice's values: quantile cuts and steps about an index of 100."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import class_for, finite

from .order import quantiles
from .panel import SLICE

CLASSES = 7


def quantile_cuts(panel: DataFrame, k: int = CLASSES) -> DataFrame:
    """The k - 1 inner quantiles of each slice (linear between values), with its extremes."""
    return quantiles(panel.where(finite("value")).select(*SLICE, "value"), SLICE, "value", [i / k for i in range(1, k)])


def class_breaks(panel: DataFrame, k: int = CLASSES) -> DataFrame:
    """(slice, class, from, to): the legend's ranges."""
    edges = quantile_cuts(panel, k).select(*SLICE, F.concat(F.array("low"), "cuts", F.array("high")).alias("_e"))
    rows = edges.select(*SLICE, "_e", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("class"))
    return rows.select(*SLICE, "class", F.get("_e", F.col("class")).alias("from"), F.get("_e", F.col("class") + 1).alias("to"))


def diverging_spread(panel: DataFrame, middle: float = 100.0) -> DataFrame:
    """How far a slice reaches from the middle, at least 1, and a third of it."""
    found = panel.where(finite("value")).groupBy(*SLICE).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    spread = F.greatest(F.abs(F.col("_low") - middle), F.abs(F.col("_high") - middle), F.lit(1.0))
    return found.select(*SLICE, spread.alias("spread"), (spread / 3).alias("step"))


def diverging_ranges(panel: DataFrame, middle: float = 100.0) -> DataFrame:
    """The legend's seven ranges about the middle, by class -3..3."""
    rows = diverging_spread(panel, middle).select(*SLICE, "step", F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("class"))
    c, step = F.col("class"), F.col("step")
    low = F.when(c < 0, middle + c * step).when(c == 0, middle - step / 2).otherwise(middle + (c - 1) * step)
    high = F.when(c < 0, middle + (c + 1) * step).when(c == 0, middle + step / 2).otherwise(middle + c * step)
    return rows.select(*SLICE, "class", low.alias("from"), high.alias("to"))


def classified(panel: DataFrame, indicator: DataFrame, k: int = CLASSES) -> DataFrame:
    """Each value with its class: about 100 for an index, by quantiles for all else."""
    cuts = quantile_cuts(panel, k).select(*SLICE, "cuts")
    rows = panel.join(cuts, SLICE, "left").join(diverging_spread(panel), SLICE, "left").join(indicator.select("geo", "indicator", "kind"), ["geo", "indicator"])
    return rows.select(*SLICE, "region_id", "value", "kind", class_for("kind", "value", "cuts", "step").alias("class"))


def bivariate_slice(panel: DataFrame, weights: DataFrame, indicator: DataFrame) -> DataFrame:
    """Region by region, the weight (size) with the value and class (colour)."""
    sized = weights.where(finite("w") & (F.col("w") > 0)).select("geo", "weight", "year", "region_id", "w")
    return sized.join(classified(panel, indicator), ["geo", "year", "region_id"]).select(*SLICE, "weight", "region_id", "w", "value", "class")
