import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import columns as C


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_half_goes_up(spark):
    assert one(spark, C.round_half_up(F.lit(-2.5), 0), C.round_half_up(F.lit(2.5), 0), C.round_half_up(F.lit(0.125), 2)) == (-2.0, 3.0, 0.13)


def test_finite(spark):
    values = [1.0, None, math.nan, math.inf, -math.inf, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(C.finite("v").alias("f")).collect()
    assert [r.f for r in rows] == [True, False, False, False, False, True]


@pytest.mark.parametrize(("v", "want"), [(104.0, 0), (105.0, 1), (115.0, 2), (70.0, -3), (99.8, 0), (None, None)])
def test_diverging_class(spark, v, want):
    assert one(spark, C.diverging_class(F.lit(v).cast("double"), F.lit(10.0)))[0] == want


def test_route_inset(spark):
    got = one(spark, *[C.route_inset(F.lit(k), F.lit(i), F.lit(lon)) for k, i, lon in (("islands", "IS00", -20.0), ("west", "IS00", -20.0), ("west", "ES70", -16.0), ("islands", "MT00", 14.0), ("none", "CY00", -20.0))])
    assert got == ("iceland", "canaries", "canaries", "east", "main")


def test_sequential_class(spark):
    cuts = F.array(*[F.lit(float(x)) for x in (1, 2, 3)])
    assert one(spark, C.sequential_class(F.lit(2.0), cuts), C.sequential_class(F.lit(9.0), cuts), C.sequential_class(F.lit(None).cast("double"), cuts)) == (1, 3, None)


def test_formats(spark):
    got = one(spark, C.format_value(F.lit(1234.5), 2, F.lit("EUR")), C.format_value(F.lit(None).cast("double"), 1), C.format_compact(F.lit(2.34e6)), C.format_compact(F.lit(45_600.0)), C.format_compact(F.lit(999.4)))
    assert got == ("1.234,50 EUR", "—", "2.3 M", "46 k", "999")
    assert one(spark, C.format_value(F.lit(-1234.00000012), 8), C.format_value(F.lit(0.25), 9)) == ("-1.234,00000012", "0,250000000")


def test_year_label_and_numeric_year(spark):
    got = one(spark, C.year_label(F.lit("a"), F.create_map(F.lit("a"), F.lit("2001"))), C.year_label(F.lit("b"), F.create_map(F.lit("a"), F.lit("2001"))), C.numeric_year(F.lit("2001")), C.numeric_year(F.lit("2001p")))
    assert got == ("2001", "b", 2001, None)


def test_ring_area(spark):
    xs, ys = ([0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 3.0, 3.0])
    row = spark.createDataFrame([(xs, ys)], "xs array<double>, ys array<double>").select(C.ring_area("xs", "ys"), C.array_mean("xs")).first()
    assert tuple(row) == (12.0, 2.0)


def test_projections_of_their_centre(spark):
    x, y = C.laea(F.lit(15.0), F.lit(54.0))
    mx, my = C.mercator(F.lit(0.0), F.lit(0.0))
    assert all(abs(v) < 1e-9 for v in one(spark, x, y, mx, my))
