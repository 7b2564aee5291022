"""Datasets files: regions, descriptors and values of a geography in one JSON object."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.tables import in_blocks, written

DESCRIPTOR = ("label", "unit", "kind", "source", "sourceUrl")
SCHEMA = (
    "regions struct<key: string, labels: map<string,string>, colors: map<string,string>>, "
    "meta map<string, string>, "
    "datasets map<string, struct<label: string, unit: string, kind: string, source: string, sourceUrl: string, decimals: int, values: map<string, map<string,double>>>>"
)


def read_datasets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parse_datasets(read_files(spark, path))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(geo, json): files named after their geography, or as write_files() writes them."""
    files = spark.read.text(path, wholetext=True)
    geo = F.col("geo").cast("string") if "geo" in files.columns else F.regexp_replace("_metadata.file_name", "-datasets.json$", "")
    return files.select(geo.alias("geo"), F.col("value").alias("json"))


def parse_meta(docs: DataFrame) -> DataFrame:
    """docs(geo, json) -> (geo, meta): the provenance of each geography, in one row however many files
    it has; of files that differ, the greatest (as JSON) stays."""
    meta = docs.select("geo", F.from_json("json", SCHEMA)["meta"].alias("meta"))
    return meta.groupBy("geo").agg(F.max_by("meta", F.to_json("meta")).alias("meta"))


def parse_datasets(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs(geo, json) -> indicator, panel, region."""
    doc = docs.select("geo", F.from_json("json", SCHEMA).alias("_d"))
    entries = doc.select("geo", F.explode("_d.datasets").alias("indicator", "_v"))
    indicator = entries.select("geo", "indicator", "_v.label", "_v.unit", "_v.kind", "_v.decimals", "_v.source", F.col("_v.sourceUrl").alias("source_url"))
    years = entries.select("geo", "indicator", F.explode("_v.values").alias("_year", "_regions"))
    panel = years.select("geo", "indicator", F.col("_year").try_cast("int").alias("year"), F.explode("_regions").alias("region_id", "value"))
    region = doc.select("geo", "_d.regions.colors", F.explode("_d.regions.labels").alias("region_id", "label"))
    return indicator, panel, region.select("geo", "region_id", "label", F.try_element_at("colors", F.col("region_id")).alias("color"))


def curated_regions(existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """existing(geo, json) -> (geo, region_id, label, color) and (geo, _others): the entries of the
    `regions` blocks of files, in one or in several a geography, and their other fields as JSON.

    A region with a colour but no label is an entry too; of entries that several files repeat, and
    of the other fields, the greatest stays. Files without a `regions` block give nothing.
    """
    text = existing.select("geo", F.get_json_object("json", "$.regions").alias("_text")).where("_text is not null")
    doc = text.select("geo", F.from_json("_text", "labels map<string,string>, colors map<string,string>").alias("_d"), F.from_json("_text", "map<string,variant>").alias("_f"))
    none = F.create_map().cast("map<string,string>")
    doc = doc.select("geo", F.coalesce("_d.labels", none).alias("_l"), F.coalesce("_d.colors", none).alias("_c"), "_f")
    each = doc.select("geo", F.explode(F.array_union(F.map_keys("_l"), F.map_keys("_c"))).alias("region_id"), "_l", "_c")
    each = each.select("geo", "region_id", F.try_element_at("_l", F.col("region_id")).alias("label"), F.try_element_at("_c", F.col("region_id")).alias("color"))
    others = F.to_json(F.map_filter("_f", lambda k, v: ~k.isin("labels", "colors")))
    return each.groupBy("geo", "region_id").agg(F.max("label").alias("label"), F.max("color").alias("color")), doc.groupBy("geo").agg(F.max(others).alias("_others"))


def datasets_json(
    panel: DataFrame, indicator: DataFrame, region: DataFrame, existing: DataFrame | None = None, meta: DataFrame | None = None, key: str = "id", most: int | None = None
) -> DataFrame:
    """(geo, json): the nested file of each geography; with `most`, several, of some `most`
    regions each, which repeat the descriptors.

    The `regions` block of a file that exists (geo, json) stays as it is written there, as it
    is curated by hand; only for other geographies it is made, from `region` (geo, region_id,
    label, and color if there is one). With `most`, the entries of that block are dealt out as the
    regions are, and each file repeats the block's other fields, so that no row holds all regions
    of a geography. `meta` (geo, meta map) is the provenance of each file.
    """
    file, others = ["geo", "_block"], None
    if most is not None and existing is not None:
        curated, others = curated_regions(existing)
        shade = F.col("color") if "color" in region.columns else F.lit(None).cast("string").alias("color")
        made = region.select("geo", "region_id", "label", shade).join(others, "geo", "left_anti")
        region, existing = written(curated.unionByName(made), "regions"), None
    if most is not None:
        ids = written(panel.select("geo", "region_id").unionByName(region.select("geo", "region_id")).distinct(), "region-ids")
        dealt = written(in_blocks(ids, ["geo"], "region_id", most), "blocks")
        panel, region = (x.join(dealt, ["geo", "region_id"]) for x in (panel, region))
        blocks = indicator.join(dealt.select(*file).distinct(), "geo", "left")
        indicator = blocks.withColumn("_block", F.coalesce("_block", F.lit(0).cast("long")))
    else:
        panel, region, indicator = (x.withColumn("_block", F.lit(0).cast("long")) for x in (panel, region, indicator))
    years = panel.groupBy(*file, "indicator", "year").agg(F.map_from_entries(F.collect_list(F.struct("region_id", "value"))).alias("_r"))
    values = years.groupBy(*file, "indicator").agg(F.map_from_entries(F.collect_list(F.struct(F.col("year").cast("string"), "_r"))).alias("values"))
    entry = F.struct("label", "unit", "kind", "source", F.col("source_url").alias("sourceUrl"), "decimals", "values")
    datasets = indicator.join(values, [*file, "indicator"], "left").groupBy(*file).agg(F.map_from_entries(F.collect_list(F.struct("indicator", entry))).alias("datasets"))
    color = F.col("color") if "color" in region.columns else F.lit(None).cast("string")
    names = region.groupBy(*file).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull() | color.isNull(), F.struct("region_id", "label")))).alias("labels"),
        F.map_from_entries(F.collect_list(F.when(color.isNotNull(), F.struct("region_id", color.alias("_c"))))).alias("colors"),
    )
    if others is None:
        out = datasets.join(names.select(*file, F.to_json(F.struct(F.lit(key).alias("key"), "labels", "colors")).alias("_made")), file, "left")
    else:
        # the fields of the curated block, without its brace, before the entries
        names = names.join(others, "geo", "left")
        fields = F.coalesce(F.when(F.col("_others") == "{}", "{").otherwise(F.regexp_replace("_others", r"\}$", ",")), F.concat(F.lit("{"), F.lit(f"{json.dumps('key')}:{json.dumps(key)},")))
        made = F.concat(fields, F.substr(F.to_json(F.struct("labels", "colors")), F.lit(2)))
        out = datasets.join(names.select(*file, made.alias("_made")), file, "left")
    kept = F.lit(None).cast("string")
    if existing is not None:
        out = out.join(existing.select("geo", F.get_json_object("json", "$.regions").alias("_kept")), "geo", "left")
        kept = F.col("_kept")
    about = F.lit("{}")
    if meta is not None:
        out = out.join(meta.select("geo", F.to_json("meta").alias("_meta")), "geo", "left")
        about = F.coalesce("_meta", F.lit("{}"))
    parts = [F.lit('{"regions":'), F.coalesce(kept, "_made", F.lit("{}")), F.lit(',"meta":'), about, F.lit(',"datasets":'), F.to_json("datasets"), F.lit("}")]
    return out.select("geo", F.concat(*parts).alias("json"))


def write_files(files: DataFrame, path: str) -> None:
    """A file for each row, under geo=...; only the geographies written now are replaced."""
    files.select("geo", "json").repartition("geo").write.option("maxRecordsPerFile", 1).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("geo").text(path)


def write_datasets(panel: DataFrame, path: str) -> None:
    """The panel by geography and indicator; only those written now are replaced."""
    panel.repartition("geo", "indicator").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("geo", "indicator").parquet(path)
