import math

from pyspark.sql import functions as F

from tessella.operators import classify, metrics, panel, quality, trend

PANEL = "geo string, indicator string, year int, region_id string, value double"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def make(spark, values):
    return spark.createDataFrame(values, PANEL)


def indicators(spark, *pairs):
    return spark.createDataFrame([("g", i, k) for i, k in pairs], "geo string, indicator string, kind string")


def region(spark, *ids):
    return spark.createDataFrame([("g", i, f"name {i}") for i in ids], "geo string, region_id string, label string")


def test_headline_weighs_with_one_where_the_weight_is_missing(spark):
    p = make(spark, [("g", "r", 2000, "x", 10.0), ("g", "r", 2000, "y", 20.0), ("g", "r", 2000, "z", math.nan)])
    w = spark.createDataFrame([("g", 2000, "x", 3.0)], "geo string, year int, region_id string, w double")
    assert rows(metrics.headline(p, w, indicators(spark, ("r", "rate"))), "value", "label") == [(12.5, "weighted mean")]
    assert rows(metrics.headline(p, w, indicators(spark, ("r", "count"))), "value", "label") == [(30.0, "Total")]


def test_headline_without_values_or_weight(spark):
    p = make(spark, [("g", "r", 2000, "x", math.nan), ("g", "r", 2000, "y", None), ("g", "r", 2001, "x", 4.0)])
    w = spark.createDataFrame([("g", 2000, "x", 3.0), ("g", 2001, "x", 0.0)], "geo string, year int, region_id string, w double")
    found = metrics.headline(p, w, indicators(spark, ("r", "rate"))).orderBy("year")
    assert rows(found, "year", "value", "label") == [(2000, None, "no data"), (2001, None, "weighted mean")]
    assert rows(metrics.headline(p, w, indicators(spark, ("r", "count"))).where("year = 2000"), "value", "label") == [(None, "no data")]


def test_rank_breaks_ties_by_region(spark):
    p = make(spark, [("g", "i", 2000, "10", 1.0), ("g", "i", 2000, "01", 1.0), ("g", "i", 2000, "z", 2.0), ("g", "i", 2000, "n", None)])
    assert rows(metrics.rank_regions(p), "pos", "region_id", "n") == [(1, "z", 3), (2, "01", 3), (3, "10", 3)]


def test_quantile_cuts(spark):
    p = make(spark, [("g", "i", 2000, str(k), float(v)) for k, v in enumerate((1, 2, 4, 8, 16))])
    cuts = classify.quantile_cuts(p).first().cuts
    assert [round(c, 4) for c in cuts[:3]] == [1.5714, 2.2857, 3.4286]


def test_base_year_and_zero_base(spark):
    p = make(spark, [("g", "i", y, r, float(y - 2000 + k)) for k, r in enumerate("ab") for y in (2000, 2001, 2002) if not (r == "b" and y == 2000)])
    base = trend.choose_base_year(p, region(spark, "a", "b"))
    assert rows(base, "base_year", "first_year", "latest_have") == [(2001, 2000, 2)]
    assert rows(trend.index_to_base(p, base), "region_id", "year", "value") == [("a", 2001, 100.0), ("a", 2002, 200.0), ("b", 2001, 100.0), ("b", 2002, 150.0)]
    zero = make(spark, [("g", "i", 2000, "a", 0.0), ("g", "i", 2001, "a", 5.0)])
    assert rows(trend.index_to_base(zero, trend.choose_base_year(zero, region(spark, "a"))), "year", "value") == [(2000, None), (2001, None)]


def test_weight_slice_falls_back_to_the_last_year_of_all(spark):
    p = make(spark, [("g", "w", 2000, "a", 1.0), ("g", "w", 2005, "a", 5.0)])
    wanted = spark.createDataFrame([("g", "w", 2000), ("g", "w", 2002)], "geo string, weight string, year int")
    assert rows(metrics.weight_slice(p, wanted), "year", "weight_year", "w") == [(2000, 2000, 1.0), (2002, 2005, 5.0)]


def test_prune_and_summarise(spark):
    p = make(spark, [("g", "i", 2000, "a", 1.0), ("g", "i", 2001, "a", 1.0), ("g", "i", 2001, "b", 1.0)])
    kept = panel.prune_sparse_years(p, panel.region_counts(region(spark, "a", "b", "c")), 0.6)
    assert rows(kept, "year", "region_id") == [(2001, "a"), (2001, "b")]
    s = panel.summarise(p, indicators(spark, ("i", "count"), ("none", "rate")))
    assert sorted((r.indicator, r.status, r.n_years) for r in s.collect()) == [("i", "ok", 2), ("none", "EMPTY", None)]


def test_quality(spark):
    p = make(spark, [("g", "i", 2000, "a", -1.0), ("g", "i", 2000, "?", math.inf)])
    i = indicators(spark, ("i", "count"), ("j", "odd"))
    assert rows(quality.negative_counts(p, i), "region_id") == [("a",)]
    assert rows(quality.non_finite_values(p), "region_id") == [("?",)]
    assert rows(quality.unknown_regions(p, region(spark, "a")), "detail") == [("?",)]
    assert rows(quality.unknown_kinds(i), "indicator", "detail") == [("j", "odd")]


def test_empty_panel(spark):
    p = make(spark, [])
    assert metrics.rank_regions(p).count() == classify.class_breaks(p).count() == panel.min_points(p).count() == 0


def test_remap_drops_unmapped(spark):
    cells = spark.createDataFrame([("x", 2.25), ("?", 1.0)], "src_code string, value double")
    cross = spark.createDataFrame([("g", "x", "r")], "geo string, src_code string, region_id string")
    assert rows(panel.remap_regions(cells, cross, 1), "region_id", "value") == [("r", 2.3)]


def test_pins(spark):
    cube = spark.createDataFrame([({"a": "1", "b": "2"}, 1.0), ({"a": "1", "b": "3"}, 2.0)], "key map<string,string>, value double")
    assert rows(panel.pin_dimensions(cube, {"b": "3"}), "value") == [(2.0,)]
    assert panel.pin_dimensions(cube, {}).count() == 2
    assert panel.pin_dimensions(cube.withColumn("p", F.create_map(F.lit("a"), F.lit("1"))), "p").count() == 2
