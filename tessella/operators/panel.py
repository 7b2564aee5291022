"""The panel (geo, indicator, year, region_id, value): building, recoding, pruning, summaries.

All tables are long. `crosswalk`, `indicator`, `region` and `metric` tables are dimensions;
Spark broadcasts them when their measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.columns import finite, numeric_year, round_half_up

SLICE = ["geo", "indicator", "year"]
SERIES = ["geo", "indicator", "region_id"]


def pin_dimensions(cube: DataFrame, pins: dict[str, str] | str) -> DataFrame:
    """Cells whose every pinned dimension has its code; pins: a dict, or a map column's name."""
    wanted = F.create_map(*[F.lit(x) for kv in pins.items() for x in kv]) if isinstance(pins, dict) else F.col(pins)
    if isinstance(pins, dict) and not pins:
        return cube
    return cube.where(F.forall(F.map_keys(wanted), lambda k: F.try_element_at(F.col("key"), k).eqNullSafe(F.try_element_at(wanted, k))))


def resolve_pick(categories: DataFrame, by: list[str], regex: str | Column) -> DataFrame:
    """Per `by` the code of the first category whose label matches; null where none does."""
    regex = F.lit(regex) if isinstance(regex, str) else regex
    hit = F.coalesce(F.regexp_like("label", regex), F.lit(False))
    return categories.groupBy(*by).agg(F.min_by(F.when(hit, F.col("code")), F.when(hit, F.col("pos"))).alias("code"))


def drop_totals(cube: DataFrame, regions: DataFrame, code: str = "src_code") -> DataFrame:
    return keep_regions(cube.where(F.col(code) != "TOTAL"), regions, code)


def keep_regions(rows: DataFrame, regions: DataFrame, code: str = "src_code") -> DataFrame:
    return rows.join(regions.select(code).distinct(), code, "left_semi")


def remap_regions(rows: DataFrame, crosswalk: DataFrame, decimals: str | int | None = None) -> DataFrame:
    """Source codes become region ids; unmapped ones go; values are rounded half up. Rows that
    have no geography yet get the crosswalk's."""
    on = ["geo", "src_code"] if "geo" in rows.columns else ["src_code"]
    out = rows.join(crosswalk.select("geo", "src_code", "region_id"), on).drop("src_code")
    return out if decimals is None else out.withColumn("value", round_half_up("value", decimals))


def unlabelled_ids(crosswalk: DataFrame, region: DataFrame) -> DataFrame:
    return crosswalk.join(region.where("label is not null"), ["geo", "region_id"], "left_anti").select("geo", "region_id").distinct()


def positive_weights(panel: DataFrame) -> DataFrame:
    return panel.where(finite("value") & (F.col("value") > 0))


def numeric_years(rows: DataFrame) -> DataFrame:
    return rows.withColumn("year", numeric_year(F.col("year").cast("string"))).where("year is not null")


def min_points(panel: DataFrame, least: int = 2) -> DataFrame:
    """Finite points of series that have at least `least` of them."""
    points = panel.where(finite("value"))
    long = points.groupBy(*SERIES).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return points.join(long.drop("_n"), SERIES, "left_semi")


def prune_sparse_years(panel: DataFrame, n_regions: DataFrame, min_coverage: float = 0.6) -> DataFrame:
    """Years with values for at least ceil(n * min_coverage) of a geography's n regions."""
    full = (
        panel.where(finite("value"))
        .groupBy(*SLICE)
        .agg(F.count("*").alias("_have"))
        .join(n_regions, "geo")
        .where(F.col("_have") >= F.ceil(F.col("n_regions") * min_coverage))
    )
    return panel.join(full.select(*SLICE), SLICE, "left_semi")


def region_counts(region: DataFrame) -> DataFrame:
    return region.groupBy("geo").agg(F.count_distinct("region_id").alias("n_regions"))


def summarise(panel: DataFrame, indicator: DataFrame) -> DataFrame:
    """First and last year, years, coverage of the last, kind; an indicator without values is EMPTY."""
    per_year = panel.where(finite("value")).groupBy(*SLICE).agg(F.count("*").alias("have"))
    spans = per_year.groupBy("geo", "indicator").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("n_years"), F.max_by("have", "year").alias("latest_regions")
    )
    return indicator.select("geo", "indicator", "kind").join(spans, ["geo", "indicator"], "left").withColumn(
        "status", F.when(F.col("n_years").isNull(), "EMPTY").otherwise("ok")
    )


def weight_candidates(indicator: DataFrame) -> DataFrame:
    """Indicators of kind count; all of a geography that has none."""
    counts = F.max((F.col("kind") == "count").cast("int")).over(W.partitionBy("geo"))
    return indicator.withColumn("_any", counts).where("kind = 'count' or coalesce(_any, 0) = 0").drop("_any")


def union_panels(*panels: DataFrame) -> DataFrame:
    out = panels[0]
    for p in panels[1:]:
        out = out.unionByName(p)
    return out


def build_panel(cube: DataFrame, metrics: DataFrame, crosswalk: DataFrame, n_regions: DataFrame, min_coverage: float = 0.6) -> DataFrame:
    """Several metrics of one read of the cells: cube(dataset, key map, value) with dims geo and
    time; metrics(geo, indicator, dataset, filter map, decimals)."""
    spec = metrics.select("geo", "indicator", "dataset", F.col("filter").alias("_pins"), "decimals")
    return panel_of_cells(pin_dimensions(cube.join(spec, "dataset"), "_pins"), crosswalk, n_regions, min_coverage)


def panel_of_cells(cells: DataFrame, crosswalk: DataFrame, n_regions: DataFrame, min_coverage: float = 0.6) -> DataFrame:
    """The panel of pinned cells (geo, indicator, decimals, key map, value), recoded and pruned."""
    rows = cells.select("geo", "indicator", F.try_element_at("key", F.lit("time")).alias("year"), F.try_element_at("key", F.lit("geo")).alias("src_code"), "value", "decimals")
    panel = numeric_years(remap_regions(rows, crosswalk, "decimals")).select(*SLICE, "region_id", "value")
    return prune_sparse_years(panel, n_regions, min_coverage)
