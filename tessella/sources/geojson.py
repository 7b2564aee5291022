"""GeoJSON boundaries as one row a ring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.tables import in_blocks


def read_geojson(spark: SparkSession, path: str, id_prop: str, fallback: str = "id") -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("geo"), F.col("value").alias("json"))
    return parse_geojson(files, id_prop, fallback)


def parse_geojson(docs: DataFrame, id_prop: str, fallback: str = "id") -> DataFrame:
    """docs(geo, json) -> ring(geo, region_id, feature_ord, poly_ord, ring_ord, xs, ys).

    Polygons and MultiPolygons; other types go. Coordinates are parsed by the geometry's type.
    """
    kind = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    rows = docs.select("geo", F.posexplode(F.from_json("json", kind)["features"]).alias("feature_ord", "_f"))
    ring = "array<array<array<double>>>"
    polygons = F.when(F.col("_f.geometry.type") == "Polygon", F.array(F.from_json("_f.geometry.coordinates", ring))).when(
        F.col("_f.geometry.type") == "MultiPolygon", F.from_json("_f.geometry.coordinates", f"array<{ring}>")
    )
    region = F.coalesce(F.try_element_at("_f.properties", F.lit(id_prop)), F.try_element_at("_f.properties", F.lit(fallback)))
    rows = rows.select("geo", region.alias("region_id"), "feature_ord", F.posexplode(polygons).alias("poly_ord", "_p"))
    rows = rows.select("geo", "region_id", "feature_ord", "poly_ord", F.posexplode("_p").alias("ring_ord", "_r"))
    return rows.select("geo", "region_id", "feature_ord", "poly_ord", "ring_ord", F.transform("_r", lambda p: p[0]).alias("xs"), F.transform("_r", lambda p: p[1]).alias("ys"))


def to_geojson(ring: DataFrame, id_prop: str, most: int = 10_000) -> DataFrame:
    """(geo, json): a FeatureCollection of MultiPolygons for each geography; one of more than
    `most` regions is dealt over several, so that each has a bounded size."""
    ring = in_blocks(ring, ["geo"], "region_id", most)
    points = F.transform(F.arrays_zip("xs", "ys"), lambda p: F.array(p["xs"], p["ys"]))
    polys = ring.groupBy("geo", "_block", "region_id", "feature_ord", "poly_ord").agg(F.array_sort(F.collect_list(F.struct("ring_ord", points.alias("p")))).alias("_r"))
    polys = polys.withColumn("_r", F.transform("_r", lambda r: r["p"]))
    features = polys.groupBy("geo", "_block", "region_id", "feature_ord").agg(F.array_sort(F.collect_list(F.struct("poly_ord", "_r"))).alias("_p"))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.transform("_p", lambda p: p["_r"]).alias("coordinates"))
    feature = F.struct("feature_ord", F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit(id_prop), F.col("region_id")).alias("properties"), geometry.alias("geometry")).alias("f"))
    made = features.groupBy("geo", "_block").agg(F.array_sort(F.collect_list(feature), lambda a, b: F.when(a["feature_ord"] < b["feature_ord"], -1).when(a["feature_ord"] > b["feature_ord"], 1).otherwise(0)).alias("_f"))
    return made.select("geo", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("_f", lambda f: f["f"]).alias("features"))).alias("json"))
