import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessella.operators import geo, grid, order

SCHEMA = StructType([StructField("g", StringType()), StructField("k", StringType()), StructField("w", DoubleType())])


def sample(seed, sizes, distinct=40):
    """Groups of the given sizes, with many equal values."""
    r = random.Random(seed)
    return [(g, f"{i:05d}", float(r.randrange(1, distinct))) for g, n in sizes.items() for i in range(n)]


def table(spark, rows, parts=5):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


SIZES = {"town": 700, "b": 90, "c": 51, "d": 50, "e": 1}


@pytest.mark.parametrize("at_once", [10**6, 50, 7])
def test_numbers_of_large_groups_equal_sorting(spark, at_once):
    rows = sample(1, SIZES)
    want = []
    for g, n in SIZES.items():
        mine = sorted([r for r in rows if r[0] == g], key=lambda r: (-r[2], r[1]))
        want += [(*r, i, n) for i, r in enumerate(mine, 1)]
    found = order.numbered(table(spark, rows), ["g"], [F.col("w").desc(), F.col("k")], "pos", "n", at_once)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert [f.dataType.simpleString() for f in found.schema.fields[-2:]] == ["int", "bigint"]


def test_numbers_of_equal_rows_nulls_and_an_empty_table(spark):
    rows = [("a", "x", 1.0)] * 30 + [(None, "x", None)] * 30
    found = order.numbered(table(spark, rows), ["g"], [F.col("w").desc_nulls_last()], "pos", at_once=10)
    for g in ("a", None):
        assert sorted(r.pos for r in found.collect() if r.g == g) == list(range(1, 31))
    empty = order.numbered(table(spark, []), ["g"], [F.col("w")], "pos", "n", 10)
    assert empty.count() == 0 and empty.columns == ["g", "k", "w", "pos", "n"]


def test_no_task_of_ranges_holds_a_group(spark):
    rows = [("town", f"{i:05d}", float(i)) for i in range(2000)]
    found = order.ranges(table(spark, rows), ["g"], [F.col("w")], 100)
    held = found.groupBy(F.spark_partition_id()).count()
    assert found.count() == 2000 and held.agg(F.max("count")).first()[0] < 1000


@pytest.mark.parametrize("seed", range(4))
def test_quantiles_of_large_groups_equal_the_aggregate(spark, seed):
    rows = sample(seed, SIZES, (3, 40, 10**6, 2)[seed])
    shares = [0.0, 1 / 7, 0.5, 0.999, 1.0]
    whole = {r.g: (r.cuts, r.low, r.high) for r in order.quantiles(table(spark, rows), ["g"], "w", shares).collect()}
    split = {r.g: (r.cuts, r.low, r.high) for r in order.quantiles(table(spark, rows), ["g"], "w", shares, 40).collect()}
    assert split == whole and set(whole) == set(SIZES)


def test_largest_remainder_of_a_large_group(spark):
    rows = sample(5, SIZES)
    whole = grid.largest_remainder(table(spark, rows), 1000, ["g"], "k").collect()
    split = grid.largest_remainder(table(spark, rows), 1000, ["g"], "k", at_once=45).collect()
    assert sorted(map(tuple, split)) == sorted(map(tuple, whole))
    assert all(sum(r.target for r in split if r.g == g) == 1000 for g in SIZES)


def test_points_of_a_crowded_square_are_dealt_out(spark):
    square = [("g", "a", 0, 0, 0, [0.0, 9.0, 9.0, 0.0], [0.0, 0.0, 9.0, 9.0]), ("g", "b", 1, 0, 0, [9.0, 20.0, 20.0, 9.0], [0.0, 0.0, 9.0, 9.0])]
    ring = spark.createDataFrame(square, "geo string, region_id string, feature_ord int, poly_ord int, ring_ord int, xs array<double>, ys array<double>")
    r = random.Random(2)
    # nine in ten lie in one square; some are there twice, some in no polygon
    points = [("g", i, r.uniform(8, 10) if i % 10 else r.uniform(-5, 25), r.uniform(1, 10)) for i in range(900)]
    made = spark.createDataFrame(points + points[:50], "geo string, id int, x double, y double")
    whole = geo.points_in_polygons(made, ring, ["id"], 4.0).collect()
    split = geo.points_in_polygons(made, ring, ["id"], 4.0, at_once=30).collect()
    assert sorted(map(tuple, split)) == sorted(map(tuple, whole))
    want = [(i, "a" if x < 9 else "b") for _, i, x, y in points + points[:50] if 0 <= x < 20 and y < 9]
    assert sorted(map(tuple, split)) == sorted(want)
