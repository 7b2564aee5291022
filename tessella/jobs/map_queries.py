"""Registered queries on files, polygons and grids; the polygons are a lattice with one place
for each part: squares, some with a hole, L shapes and pairs of islands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.tables import by_merge, fresh_path, written
from tessella.functions.columns import laea, mercator, round_half_up
from tessella.operators import allocate, geo, grid, panel, quality
from tessella.sources import datasets, geojson, jsonstat

from . import sample_panel as S
from .queries import register
from .sample_panel import r

COLUMNS = 50

#: The lattice in SQL: corner, kind and geography of each part's place.
LATTICE = f"""lat AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS region_id, p_brand AS geo, p_partkey % 5 AS t,
  10.0 * (p_partkey % {COLUMNS}) + 1 AS x0, 10.0 * (p_partkey // {COLUMNS}) + 1 AS y0 FROM part)"""


def lattice(spark, sf_dir, one_map: bool = False) -> DataFrame:
    """ring table of the lattice, a geography a brand (or one for all)."""
    k = F.col("p_partkey")
    rows = S.read(spark, sf_dir, "part").select(
        F.lit("all").alias("geo") if one_map else F.col("p_brand").alias("geo"), k.cast("string").alias("region_id"), k.cast("int").alias("feature_ord"),
        (k % 5).alias("_t"), (10.0 * (k % COLUMNS) + 1).alias("_x"), (10.0 * F.floor(k / COLUMNS) + 1).alias("_y"),
    )

    def ring(poly: int, order: int, points: list[tuple[int, int]]):
        return F.struct(
            F.lit(poly).alias("poly_ord"), F.lit(order).alias("ring_ord"),
            F.array(*[F.col("_x") + a for a, _ in points]).alias("xs"), F.array(*[F.col("_y") + b for _, b in points]).alias("ys"),
        )

    def box(a, b, c, d):
        return [(a, b), (c, b), (c, d), (a, d)]

    rings = (
        F.when(F.col("_t") == 0, F.array(ring(0, 0, box(0, 0, 8, 8)), ring(0, 1, box(3, 3, 5, 5))))
        .when(F.col("_t") == 1, F.array(ring(0, 0, [(0, 0), (8, 0), (8, 4), (4, 4), (4, 8), (0, 8)])))
        .when(F.col("_t") == 2, F.array(ring(0, 0, box(0, 0, 3, 8)), ring(1, 0, box(5, 0, 8, 8))))
        .otherwise(F.array(ring(0, 0, box(0, 0, 8, 8))))
    )
    # a table, as boundaries are: the optimizer would copy the long expressions into each filter
    return written(rows.select("geo", "region_id", "feature_ord", F.inline(rings)), "rings")


def _rounded(df: DataFrame, *columns: str, d: int = 6) -> DataFrame:
    return df.withColumns({c: round_half_up(c, d) for c in columns})


RINGS = """rings AS (
  SELECT *, 0 AS poly_ord, 0 AS ring_ord, 64.0 AS area, x0 + 4 AS cx, y0 + 4 AS cy FROM lat WHERE t IN (0, 3, 4)
  UNION ALL SELECT *, 0, 1, 4.0, x0 + 4, y0 + 4 FROM lat WHERE t = 0
  UNION ALL SELECT *, 0, 0, 48.0, x0 + 4, y0 + 4 FROM lat WHERE t = 1
  UNION ALL SELECT *, 0, 0, 24.0, x0 + 1.5, y0 + 4 FROM lat WHERE t = 2
  UNION ALL SELECT *, 1, 0, 24.0, x0 + 6.5, y0 + 4 FROM lat WHERE t = 2)"""


@register("ring_measures", f", {LATTICE}, {RINGS} SELECT geo, region_id, CAST(k AS INTEGER) AS feature_ord, poly_ord, ring_ord, CAST(area AS DOUBLE) AS area, CAST(cx AS DOUBLE) AS cx, CAST(cy AS DOUBLE) AS cy FROM rings")
def ring_measures(spark, sf_dir):
    return _rounded(geo.ring_measures(lattice(spark, sf_dir)), "area", "cx", "cy")


@register("geojson_round_trip", f", {LATTICE}, {RINGS} SELECT geo, region_id, poly_ord, ring_ord, CAST(area AS DOUBLE) AS area FROM rings")
def geojson_round_trip(spark, sf_dir):
    rings = geojson.parse_geojson(geojson.to_geojson(lattice(spark, sf_dir), "id"), "id")
    return _rounded(geo.ring_measures(geo.valid_rings(rings)), "area").select("geo", "region_id", "poly_ord", "ring_ord", "area")


@register("land_area", f", {LATTICE} SELECT geo, CAST(sum(CASE t WHEN 0 THEN 60 WHEN 1 THEN 48 WHEN 2 THEN 48 ELSE 64 END) AS DOUBLE) AS area FROM lat GROUP BY geo")
def land_area(spark, sf_dir):
    return _rounded(geo.land_area(lattice(spark, sf_dir)), "area")


SEEDS = "SELECT geo, region_id, CAST(CASE t WHEN 2 THEN x0 + 1.5 ELSE x0 + 4 END AS DOUBLE) AS x, CAST(y0 + 4 AS DOUBLE) AS y FROM lat"


@register("region_seed", f", {LATTICE} {SEEDS}")
def region_seed(spark, sf_dir):
    return _rounded(geo.region_seed(lattice(spark, sf_dir)), "x", "y")


@register("label_centroid", f", {LATTICE} {SEEDS}")
def label_centroid(spark, sf_dir):
    return _rounded(geo.label_centroid(lattice(spark, sf_dir)), "x", "y")


@register("bounds", f", {LATTICE} SELECT geo, CAST(min(x0) AS DOUBLE) AS x0, CAST(max(x0) + 8 AS DOUBLE) AS x1, CAST(min(y0) AS DOUBLE) AS y0, CAST(max(y0) + 8 AS DOUBLE) AS y1 FROM lat WHERE t <> 3 GROUP BY geo")
def bounds(spark, sf_dir):
    return geo.bounds(lattice(spark, sf_dir), F.col("feature_ord") % 5 != 3)


#: Brands that end in 1 or 2 have a western inset, in 3 or 4 islands, in 5 none.
INSETS = """kinds AS (SELECT *, CASE WHEN right(geo, 1) IN ('1', '2') THEN 'west' WHEN right(geo, 1) IN ('3', '4') THEN 'islands' ELSE 'none' END AS insets,
    CASE t WHEN 0 THEN 'IS' WHEN 1 THEN 'MT' WHEN 2 THEN 'CY' ELSE 'ES' END || region_id AS code, x0 - 111 AS lon FROM lat),
  placed AS (SELECT *, CASE WHEN insets = 'west' AND lon <= -10 THEN 'canaries' WHEN insets = 'islands' AND t = 0 THEN 'iceland' WHEN insets = 'islands' AND t IN (1, 2) THEN 'east' ELSE 'main' END AS inset FROM kinds)"""


def _inset_maps(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The lattice moved to the west with ids of islands, and the inset rules of each brand."""
    prefix = F.element_at(F.array(F.lit("IS"), F.lit("MT"), F.lit("CY"), F.lit("ES"), F.lit("ES")), (F.col("feature_ord") % 5 + 1).cast("int"))
    rings = lattice(spark, sf_dir).withColumn("region_id", F.concat(prefix, "region_id")).withColumn("xs", F.transform("xs", lambda x: x - 111))
    last = F.substring("geo", -1, 1)
    kinds = rings.select("geo").distinct().select("geo", F.when(last.isin("1", "2"), "west").when(last.isin("3", "4"), "islands").otherwise("none").alias("insets"))
    return rings, kinds


#: A box of the canvas of 900 x 780 for each map and inset; the western one by its share of the drawn parts.
BOXES = """usable AS (SELECT (900 - 22) * (780 - 96) AS u),
  share AS (SELECT geo, insets, count(*) FILTER (inset = 'canaries' AND drawn) / greatest(1, count(*) FILTER (drawn)) AS s FROM (SELECT *, k % 3 <> 0 AS drawn FROM placed) GROUP BY geo, insets),
  area AS (SELECT geo, insets, greatest(u * 0.04, least(u * 0.26, s * u * 1.35)) AS a FROM share, usable),
  wide AS (SELECT geo, insets, a, greatest(180.0, least(504.0, sqrt(a * 1.7))) AS w FROM area),
  high AS (SELECT geo, insets, w, greatest(78.0, least(234.0, a / w)) AS h FROM wide),
  boxes AS (
    SELECT geo, 'main' AS inset, CAST(10 AS DOUBLE) AS bx0, CAST(62 AS DOUBLE) AS by0, CAST(890 AS DOUBLE) AS bx1, CASE insets WHEN 'west' THEN 780 - h - 60 WHEN 'islands' THEN 766.0 ELSE 750.0 END AS by1, CASE insets WHEN 'islands' THEN 9 ELSE 1 END AS least FROM high
    UNION ALL SELECT geo, 'canaries', 12.0, 780 - h - 34, 12 + w, 746.0, 1 FROM high WHERE insets = 'west'
    UNION ALL SELECT geo, 'iceland', 14.0, 66.0, 68.0, 120.6, NULL FROM high WHERE insets = 'islands'
    UNION ALL SELECT geo, 'east', CAST(832 AS DOUBLE), CAST(695.4 AS DOUBLE), CAST(886 AS DOUBLE), CAST(750 AS DOUBLE), NULL FROM high WHERE insets = 'islands')"""


def _boxes(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    rings, kinds = _inset_maps(spark, sf_dir)
    rings = rings.join(geo.inset_of(rings, kinds), ["geo", "region_id"])
    drawn = rings.where("feature_ord % 3 <> 0").select("geo", "region_id", "inset").distinct()
    share = drawn.groupBy("geo").agg((F.count_if(F.col("inset") == "canaries") / F.count("*")).alias("share"))
    maps = kinds.join(share, "geo", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    return rings, geo.inset_boxes(maps, 900, 780), drawn.select("geo", "region_id")


@register(
    "fit_extent",
    f""", {LATTICE}, {INSETS}, {BOXES}, seen AS (SELECT p.*, p.k % 3 <> 0 AS drawn, count(*) FILTER (p.k % 3 <> 0) OVER (PARTITION BY geo) AS n_drawn FROM placed p),
e AS (SELECT geo, inset, min(lon) AS a, max(lon) + 8 AS b, min(y0) AS c, max(y0) + 8 AS d FROM seen JOIN boxes USING (geo, inset) WHERE drawn OR NOT coalesce(n_drawn >= least, false) GROUP BY geo, inset),
f AS (SELECT *, least((bx1 - bx0) / (b - a), (by1 - by0) / (d - c)) AS s FROM e JOIN boxes USING (geo, inset))
SELECT geo, code AS region_id, inset, {r("(lon + 4) * f.s + (bx0 + bx1) / 2 - f.s * (a + b) / 2", 6)} AS x, {r("(y0 + 4) * f.s + (by0 + by1) / 2 - f.s * (c + d) / 2", 6)} AS y
FROM placed JOIN f USING (geo, inset) WHERE t <> 2""",
)
def fit_extent(spark, sf_dir):
    # of the pairs of equal islands rounding decides which is larger
    rings, boxes, drawn = _boxes(spark, sf_dir)
    fitted = geo.fit_extent(rings, boxes, drawn).where("feature_ord % 5 <> 2")
    seeds = geo.region_seed(fitted).join(fitted.select("geo", "region_id", "inset").distinct(), ["geo", "region_id"])
    return _rounded(seeds.select("geo", "region_id", "inset", "x", "y"), "x", "y", d=6)


@register(
    "projections",
    f"""SELECT c_custkey, {r("radians(lon)", 9)} AS mx, {r("ln(tan(pi() / 4 + radians(lat) / 2))", 9)} AS my, {r("k * cos(radians(lat)) * sin(radians(lon - 15))", 9)} AS ax,
  {r("k * (cos(radians(54.0)) * sin(radians(lat)) - sin(radians(54.0)) * cos(radians(lat)) * cos(radians(lon - 15)))", 9)} AS ay
FROM (SELECT *, sqrt(2 / (1 + sin(radians(54.0)) * sin(radians(lat)) + cos(radians(54.0)) * cos(radians(lat)) * cos(radians(lon - 15)))) AS k
  FROM (SELECT c_custkey, CAST(c_custkey % 600 AS DOUBLE) / 10 - 20 AS lon, CAST(c_custkey % 350 AS DOUBLE) / 10 + 34 AS lat FROM customer))""",
)
def projections(spark, sf_dir):
    rows = S.read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 600 / 10 - 20).alias("lon"), (F.col("c_custkey") % 350 / 10 + 34).alias("lat"))
    (mx, my), (ax, ay) = mercator("lon", "lat"), laea("lon", "lat")
    return _rounded(rows.select("c_custkey", mx.alias("mx"), my.alias("my"), ax.alias("ax"), ay.alias("ay")), "mx", "my", "ax", "ay", d=9)


@register(
    "route_inset",
    f""", {LATTICE}, {INSETS} SELECT geo, code AS region_id, inset FROM placed""",
)
def route_inset(spark, sf_dir):
    return geo.inset_of(*_inset_maps(spark, sf_dir))


@register("inset_box", f""", {LATTICE}, {INSETS}, {BOXES} SELECT geo, inset, {", ".join(r(c, 6) + f" AS {c}" for c in ("bx0", "by0", "bx1", "by1"))}, CAST(least AS INTEGER) AS least FROM boxes""")
def inset_box(spark, sf_dir):
    return _rounded(_boxes(spark, sf_dir)[1], "bx0", "by0", "bx1", "by1")


@register(
    "dorling_radius",
    f"""SELECT map_id, region_id, w, {r("greatest(2.5, sqrt(w * (0.42 * (900 - 40) * (780 - 120) / sum(w) OVER (PARTITION BY map_id)) / pi()))", 6)} AS radius
FROM (SELECT geo || '|' || year AS map_id, region_id, value AS w FROM fine WHERE indicator = 'qty')""",
)
def dorling_radius(spark, sf_dir):
    return _rounded(geo.dorling_radius(_weights(spark, sf_dir)), "radius")


def _weights(spark, sf_dir) -> DataFrame:
    p = S.fine_panel(spark, sf_dir).where("indicator = 'qty'")
    return p.select(F.concat_ws("|", "geo", "year").alias("map_id"), "region_id", F.col("value").alias("w"))


@register(
    "scale_polygons",
    f""", {LATTICE}, {RINGS}, w AS (SELECT k, sum(l_quantity) AS w FROM lineitem JOIN lat ON k = l_partkey GROUP BY k), m AS (SELECT geo, max(w) AS top FROM w JOIN lat USING (k) GROUP BY geo)
SELECT geo, region_id, poly_ord, ring_ord, {r("area * (w / top)", 6)} AS area FROM rings JOIN w USING (k) JOIN m USING (geo)""",
)
def scale_polygons(spark, sf_dir):
    w = S.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("region_id")).agg(F.sum("l_quantity").alias("w"))
    rings = lattice(spark, sf_dir)
    w = w.join(rings.select("geo", "region_id").distinct(), "region_id")
    return _rounded(geo.ring_measures(geo.scale_polygons(rings, w)), "area").select("geo", "region_id", "poly_ord", "ring_ord", "area")


POINTS = f"pts AS (SELECT l_orderkey, l_linenumber, ((l_orderkey * 37 + l_linenumber * 11) % {COLUMNS * 100}) / 10.0 AS x, ((l_partkey * 13 + l_linenumber * 7) % 2000) / 10.0 AS y FROM lineitem)"


@register("points_in_polygons", f""", {LATTICE}, {POINTS}, placed AS (SELECT *, CAST(floor(x / 10) AS BIGINT) + {COLUMNS} * CAST(floor(y / 10) AS BIGINT) AS k FROM pts),
j AS (SELECT p.*, region_id, t, x - x0 AS a, y - y0 AS b FROM placed p JOIN lat USING (k))
SELECT l_orderkey, l_linenumber, region_id FROM j WHERE a >= 0 AND a < 8 AND b >= 0 AND b < 8
  AND NOT (t = 0 AND a >= 3 AND a < 5 AND b >= 3 AND b < 5) AND NOT (t = 1 AND a >= 4 AND b >= 4) AND NOT (t = 2 AND a >= 3 AND a < 5)""")
def points_in_polygons(spark, sf_dir):
    rows = S.read(spark, sf_dir, "lineitem")
    points = rows.select(
        "l_orderkey", "l_linenumber", F.lit("all").alias("geo"), ((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % (COLUMNS * 100) / 10).alias("x"),
        ((F.col("l_partkey") * 13 + F.col("l_linenumber") * 7) % 2000 / 10).alias("y"),
    )
    return geo.points_in_polygons(points, lattice(spark, sf_dir, True), ["l_orderkey", "l_linenumber"], 10.0)


@register("largest_remainder", """, e AS (SELECT geo || '|' || year AS map_id, region_id, value AS w, value * 1000 / sum(value) OVER (PARTITION BY geo, year) AS e FROM fine WHERE indicator = 'qty'),
f AS (SELECT *, CAST(1000 - sum(floor(e)) OVER (PARTITION BY map_id) AS BIGINT) AS more, row_number() OVER (PARTITION BY map_id ORDER BY e - floor(e) DESC, region_id) AS k FROM e)
SELECT map_id, region_id, w, CAST(floor(e) + CASE WHEN k <= more THEN 1 ELSE 0 END AS INTEGER) AS target FROM f""")  # fmt: skip
def largest_remainder(spark, sf_dir):
    return grid.largest_remainder(_weights(spark, sf_dir), 1000, ["map_id"])


#: A grid of 50 x 20 cells for each thousand parts; each seventh place is empty.
CELLS = """cells AS (SELECT 'm' || (p_partkey // 1000) AS map_id, CAST(p_partkey % 50 AS INTEGER) AS col, CAST((p_partkey % 1000) // 50 AS INTEGER) AS row,
  'r' || CAST((p_partkey % 50) // 7 + 10 * ((p_partkey % 1000) // 250) + CASE WHEN p_size < 5 THEN 1 ELSE 0 END AS INTEGER) AS region_id FROM part WHERE p_partkey % 7 <> 0 OR p_size < 20)"""


def cells_of_parts(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    area = F.floor(k % 50 / 7) + 10 * F.floor(k % 1000 / 250) + F.when(F.col("p_size") < 5, 1).otherwise(0)
    return S.read(spark, sf_dir, "part").where("p_partkey % 7 <> 0 or p_size < 20").select(
        F.concat(F.lit("m"), F.floor(k / 1000)).alias("map_id"), (k % 50).cast("int").alias("col"), F.floor(k % 1000 / 50).cast("int").alias("row"), F.concat(F.lit("r"), area.cast("int")).alias("region_id"),
        (k % 50).cast("double").alias("x"), F.floor(k % 1000 / 50).cast("double").alias("y"),
    )


NEAR = "near AS (SELECT a.map_id, a.col, a.row, a.region_id, b.region_id AS n_region FROM cells a JOIN cells b ON a.map_id = b.map_id AND abs(a.col - b.col) + abs(a.row - b.row) = 1)"


@register("exposure", f", {CELLS}, {NEAR} SELECT c.*, CAST(4 - (SELECT count(*) FROM near n WHERE n.map_id = c.map_id AND n.col = c.col AND n.row = c.row AND n.region_id = n.n_region) AS INTEGER) AS exposure FROM cells c")
def exposure(spark, sf_dir):
    return grid.exposure(cells_of_parts(spark, sf_dir))


@register("region_adjacency", f", {CELLS}, {NEAR} SELECT DISTINCT map_id, region_id, n_region FROM near WHERE region_id <> n_region")
def region_adjacency(spark, sf_dir):
    return grid.region_adjacency(cells_of_parts(spark, sf_dir))


HOLES = "holes AS (SELECT 'm' || (p_partkey // 1000) AS map_id, CAST(p_partkey % 50 AS INTEGER) AS col, CAST((p_partkey % 1000) // 50 AS INTEGER) AS row FROM part WHERE NOT (p_partkey % 7 <> 0 OR p_size < 20))"


@register(
    "majority_region",
    f""", {CELLS}, {HOLES}, n AS (SELECT h.*, c.region_id, count(*) AS n FROM holes h JOIN cells c ON c.map_id = h.map_id AND abs(c.col - h.col) + abs(c.row - h.row) = 1 GROUP BY ALL)
SELECT map_id, col, row, region_id FROM n QUALIFY row_number() OVER (PARTITION BY map_id, col, row ORDER BY n DESC, region_id) = 1""",
)
def majority_region(spark, sf_dir):
    k = F.col("p_partkey")
    holes = S.read(spark, sf_dir, "part").where("not (p_partkey % 7 <> 0 or p_size < 20)")
    holes = holes.select(F.concat(F.lit("m"), F.floor(k / 1000)).alias("map_id"), (k % 50).cast("int").alias("col"), F.floor(k % 1000 / 50).cast("int").alias("row"))
    return grid.majority_region(cells_of_parts(spark, sf_dir), holes)


@register(
    "nearest_cell",
    f""", {CELLS}, p AS (SELECT s_suppkey, 'm' || (s_suppkey % 2) AS map_id, (s_suppkey * 7 % 500) / 10.0 + 0.03 AS x, (s_suppkey * 3 % 200) / 10.0 + 0.01 AS y FROM supplier)
SELECT p.map_id, s_suppkey, c.col, c.row FROM p JOIN cells c USING (map_id) QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY round((x - c.col) * (x - c.col) + (y - c.row) * (y - c.row), 6), c.col, c.row) = 1""",
)
def nearest_cell(spark, sf_dir):
    points = S.read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("m"), F.col("s_suppkey") % 2).alias("map_id"), (F.col("s_suppkey") * 7 % 500 / 10 + 0.03).alias("x"), (F.col("s_suppkey") * 3 % 200 / 10 + 0.01).alias("y"))
    return geo.nearest_cell(points, cells_of_parts(spark, sf_dir), "map_id", ["s_suppkey"])


TARGETS = "targets AS (SELECT map_id, region_id, CAST(count(*) + (count(*) * 7 % 5) - 2 AS INTEGER) AS target FROM cells GROUP BY ALL)"


def _targets(cells: DataFrame) -> DataFrame:
    n = F.count("*")
    return cells.groupBy("map_id", "region_id").agg((n + n * 7 % 5 - 2).cast("int").alias("target"))


@register(
    "allocation_error",
    f""", {CELLS}, {TARGETS}, e AS (SELECT t.map_id, abs(count(c.col) - target) / target * 100 AS e FROM targets t LEFT JOIN cells c USING (map_id, region_id) WHERE target >= 3 GROUP BY t.map_id, t.region_id, target)
SELECT map_id, {r("avg(e)", 6)} AS mean, {r("list_sort(list(e))[count(*) // 2 + 1]", 6)} AS median, {r("max(e)", 6)} AS max, count(*) AS n FROM e GROUP BY map_id""",
)
def allocation_error(spark, sf_dir):
    cells = cells_of_parts(spark, sf_dir)
    return _rounded(grid.allocation_error(cells, _targets(cells)), "mean", "median", "max")


@register(
    "worst_allocations",
    f""", {CELLS}, {TARGETS}, e AS (SELECT map_id, region_id, target, count(c.col) AS got, CAST(floor((count(c.col) - target) / target * 100 + 0.5) AS INTEGER) AS error FROM targets t LEFT JOIN cells c USING (map_id, region_id) WHERE target >= 3 GROUP BY map_id, region_id, target),
q AS (SELECT *, CAST(row_number() OVER (PARTITION BY map_id ORDER BY abs(error) DESC, region_id) AS INTEGER) AS pos FROM e) SELECT * FROM q WHERE pos <= 4""",
)
def worst_allocations(spark, sf_dir):
    cells = cells_of_parts(spark, sf_dir)
    return grid.worst_allocations(cells, _targets(cells))


@register(
    "compactness",
    f""", {CELLS}, c AS (SELECT map_id, region_id, avg(col) AS cx, avg(row) AS cy, count(*) AS n FROM cells GROUP BY ALL HAVING count(*) >= 8),
e AS (SELECT map_id, region_id, avg(sqrt((col - cx) * (col - cx) + (row - cy) * (row - cy))) / (2.0 / 3 * sqrt(n / pi())) AS v FROM cells JOIN c USING (map_id, region_id) GROUP BY map_id, region_id, n)
SELECT map_id, {r("avg(v)", 6)} AS compactness, count(*) AS regions FROM e GROUP BY map_id""",
)
def compactness(spark, sf_dir):
    return _rounded(grid.compactness(cells_of_parts(spark, sf_dir)), "compactness")


@register(
    "drift",
    f""", {CELLS}, d AS (SELECT map_id, region_id, sqrt(power(avg(col) - (min(col) + max(col)) / 2.0, 2) + power(avg(row) - (min(row) + max(row)) / 2.0, 2)) / 50 AS d FROM cells GROUP BY ALL)
SELECT map_id, {r("avg(d)", 6)} AS mean, {r("list_sort(list(d))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1]", 6)} AS p95, count(*) AS n FROM d GROUP BY map_id""",
)
def drift(spark, sf_dir):
    cells = cells_of_parts(spark, sf_dir)
    centres = cells.groupBy("map_id", "region_id").agg(((F.min("x") + F.max("x")) / 2).alias("x"), ((F.min("y") + F.max("y")) / 2).alias("y"))
    return _rounded(grid.drift(cells, centres, cells.select("map_id", F.lit(50.0).alias("diagonal")).distinct()), "mean", "p95")


#: All cells that a cell's region reaches from it, by steps along the sides.
REACH = """reach AS (SELECT map_id, region_id, col AS c0, row AS r0, col, row FROM cells UNION
  SELECT c.map_id, c.region_id, c0, r0, c.col, c.row FROM reach q JOIN cells c ON c.map_id = q.map_id AND c.region_id = q.region_id AND abs(c.col - q.col) + abs(c.row - q.row) = 1),
parts AS (SELECT map_id, region_id, c0 AS col, r0 AS row, min(CAST(col AS BIGINT) * 1048576 + row) AS component FROM reach GROUP BY ALL)"""
PIECES = "pieces AS (SELECT map_id, count(*) AS regions, count(*) FILTER (n > 1) AS fragmented FROM (SELECT map_id, region_id, count(DISTINCT component) AS n FROM parts GROUP BY ALL) GROUP BY map_id)"


@register("grid_components", f", {CELLS}, {REACH} SELECT *, CAST(col AS DOUBLE) AS x, CAST(row AS DOUBLE) AS y FROM parts")
def grid_components(spark, sf_dir):
    return grid.grid_components(cells_of_parts(spark, sf_dir), ["region_id"])


@register("fragmentation", f", {CELLS}, {REACH}, {PIECES} SELECT * FROM pieces")
def fragmentation(spark, sf_dir):
    return grid.fragmentation(cells_of_parts(spark, sf_dir))


#: The holes of this grid never touch, so that the order in which they are filled is all one.
@register(
    "fill_enclosed",
    f""", {CELLS}, b AS (SELECT map_id, min(col) - 1 AS a, max(col) + 1 AS b, min(row) - 1 AS c, max(row) + 1 AS d FROM cells GROUP BY map_id),
g AS (SELECT b.*, unnest(range(a, b + 1)) AS col FROM b), g2 AS (SELECT g.*, unnest(range(c, d + 1)) AS row FROM g), free AS (SELECT map_id, a, c, CAST(col AS INTEGER) AS col, CAST(row AS INTEGER) AS row FROM g2 ANTI JOIN cells USING (map_id, col, row)),
sea AS (SELECT map_id, col, row FROM free WHERE col = a AND row = c UNION SELECT f.map_id, f.col, f.row FROM sea s JOIN free f ON f.map_id = s.map_id AND abs(f.col - s.col) + abs(f.row - s.row) = 1),
n AS (SELECT h.map_id, h.col, h.row, x.region_id, count(*) AS n FROM (SELECT map_id, col, row FROM free ANTI JOIN sea USING (map_id, col, row)) h JOIN cells x ON x.map_id = h.map_id AND abs(x.col - h.col) + abs(x.row - h.row) = 1 GROUP BY ALL)
SELECT map_id, col, row, region_id FROM cells UNION ALL SELECT map_id, col, row, region_id FROM (SELECT *, row_number() OVER (PARTITION BY map_id, col, row ORDER BY n DESC, region_id) AS k FROM n) WHERE k = 1""",
)
def fill_enclosed(spark, sf_dir):
    return grid.fill_enclosed(cells_of_parts(spark, sf_dir))


def _run(to: str, dc: int, dr: int) -> str:
    """Steps from each cell that stay in its region, at most 40."""
    return f"""{to} AS (SELECT map_id, region_id, col, row, 0 AS n FROM cells UNION ALL SELECT q.map_id, q.region_id, q.col, q.row, n + 1 FROM {to} q
  JOIN cells c ON c.map_id = q.map_id AND c.region_id = q.region_id AND c.col = q.col + (n + 1) * {dc} AND c.row = q.row + (n + 1) * {dr} WHERE n < 40)"""


@register(
    "open_cell",
    f""", {CELLS}, {_run('lf', -1, 0)}, {_run('rt', 1, 0)}, {_run('up', 0, -1)}, {_run('dn', 0, 1)},
m AS (SELECT map_id, region_id, col, row, 2 * least(a, b) + 1 AS w, 2 * least(c, d) + 1 AS h FROM (SELECT map_id, region_id, col, row, max(n) AS a FROM lf GROUP BY ALL) JOIN (SELECT map_id, region_id, col, row, max(n) AS b FROM rt GROUP BY ALL) USING (map_id, region_id, col, row)
  JOIN (SELECT map_id, region_id, col, row, max(n) AS c FROM up GROUP BY ALL) USING (map_id, region_id, col, row) JOIN (SELECT map_id, region_id, col, row, max(n) AS d FROM dn GROUP BY ALL) USING (map_id, region_id, col, row))
SELECT map_id, region_id, col, row, CAST(w AS DOUBLE) AS width, CAST(h AS DOUBLE) AS height FROM m QUALIFY row_number() OVER (PARTITION BY map_id, region_id ORDER BY least(w, 3.2 * h) DESC, row, col) = 1""",
)
def open_cell(spark, sf_dir):
    return grid.open_cell(cells_of_parts(spark, sf_dir))


ALL_REACH = REACH.replace(" AND c.region_id = q.region_id", "").replace("c.region_id, c0", "q.region_id, c0")


@register(
    "region_placement",
    f""", {CELLS}, {ALL_REACH} SELECT map_id, component, region_id, count(*) AS here FROM parts GROUP BY ALL
UNION ALL SELECT map_id, component, 'lost', 1 FROM parts QUALIFY row_number() OVER (PARTITION BY map_id ORDER BY power(col - 20.2, 2) + power(row - 7.1, 2)) = 1""",
)
def region_placement(spark, sf_dir):
    """One more region without a cell goes where its seed is nearest."""
    cells = grid.grid_components(cells_of_parts(spark, sf_dir))
    lost = cells.select("map_id").distinct().select("map_id", F.lit("lost").alias("region_id"))
    seeds = lost.select("map_id", "region_id", F.lit(20.2).alias("x"), F.lit(7.1).alias("y"))
    return grid.region_placement(cells, _targets(cells).unionByName(lost.withColumn("target", F.lit(9))), seeds)


@register(
    "component_budget",
    f""", {CELLS}, {TARGETS}, {ALL_REACH}, p AS (SELECT map_id, component, region_id, count(*) AS here FROM parts GROUP BY ALL),
w AS (SELECT p.*, target * here / sum(here) OVER (PARTITION BY map_id, region_id) AS w FROM p JOIN targets USING (map_id, region_id) WHERE target > 0),
t AS (SELECT map_id, component, CAST(floor(sum(w) + 0.5) AS INTEGER) AS total FROM w GROUP BY ALL), e AS (SELECT w.*, total, w * total / sum(w) OVER (PARTITION BY map_id, component) AS e FROM w JOIN t USING (map_id, component) WHERE total > 0),
f AS (SELECT *, total - sum(floor(e)) OVER (PARTITION BY map_id, component) AS more, row_number() OVER (PARTITION BY map_id, component ORDER BY e - floor(e) DESC, region_id) AS k FROM e)
SELECT map_id, component, region_id, total, CAST(floor(e) + CASE WHEN k <= more THEN 1 ELSE 0 END AS INTEGER) AS budget FROM f""",
)
def component_budget(spark, sf_dir):
    cells = grid.grid_components(cells_of_parts(spark, sf_dir))
    targets = _targets(cells)
    seeds = cells.groupBy("map_id", "region_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return grid.component_budget(grid.region_placement(cells, targets, seeds), targets)


BLOCK = 100


def _cartogram(spark, sf_dir):
    """A map for each hundred parts, squares side by side; the latest year's quantities make the sizes."""
    k = F.col("p_partkey")
    place = lambda i: (10.0 * i).alias("_at")
    parts = S.read(spark, sf_dir, "part").select(
        k, F.concat(F.lit("b"), F.floor(k / BLOCK)).alias("geo"), k.cast("string").alias("region_id"), k.cast("int").alias("feature_ord"), F.lit(0).alias("poly_ord"), F.lit(0).alias("ring_ord"),
        place(k % 10).alias("_x"), place(F.floor(k % BLOCK / 10)).alias("_y"),
    )
    box = lambda c, *d: F.array(*[F.col(c) + float(v) for v in d])
    rings = parts.withColumn("xs", box("_x", 0, 10, 10, 0)).withColumn("ys", box("_y", 0, 0, 10, 10)).drop("_x", "_y", "p_partkey")
    return rings, *allocate.cartogram(_last_year(spark, sf_dir, parts.select("geo", "region_id", k.alias("p_partkey"))), rings, 1000)


def _last_year(spark, sf_dir, parts: DataFrame) -> DataFrame:
    """The quantities of each geography's latest year as weights; parts(geo, region_id, p_partkey)."""
    shipped = S.quantities(spark, sf_dir).join(by_merge(parts), "p_partkey")
    last = shipped.withColumn("_last", F.max("year").over(W.partitionBy("geo"))).where("year = _last")
    return last.select(F.concat_ws("|", "geo", "year").alias("map_id"), "geo", "region_id", F.col("value").alias("w"))


@register("cartogram")
def cartogram(spark, sf_dir):
    return _cartogram(spark, sf_dir)[1]


#: Each region's tiles by largest remainder, of the maps of squares, where nothing stands in the way of a budget.
SIZES = f""", w AS (SELECT 'b' || CAST(CAST(region_id AS BIGINT) // {BLOCK} AS VARCHAR) AS g, region_id, year, value FROM fine WHERE indicator = 'qty'),
l AS (SELECT g, max(year) AS year FROM w GROUP BY g), v AS (SELECT g || '|' || CAST(year AS VARCHAR) AS map_id, region_id, value * 1000 / sum(value) OVER (PARTITION BY g) AS e FROM w JOIN l USING (g, year) WHERE value > 0),
f AS (SELECT *, 1000 - sum(floor(e)) OVER (PARTITION BY map_id) AS more, row_number() OVER (PARTITION BY map_id ORDER BY e - floor(e) DESC, region_id) AS k FROM v)
SELECT * FROM (SELECT map_id, region_id, CAST(floor(e) + CASE WHEN k <= more THEN 1 ELSE 0 END AS BIGINT) AS cells FROM f) WHERE cells > 0"""


@register("cartogram_sizes", SIZES)
def cartogram_sizes(spark, sf_dir):
    """The cells that each region of the cartogram has."""
    return _cartogram(spark, sf_dir)[1].groupBy("map_id", "region_id").agg(F.count("*").alias("cells"))


@register("cartogram_measures")
def cartogram_measures(spark, sf_dir):
    """What each map of the cartogram is judged by."""
    rings, cells, targets = _cartogram(spark, sf_dir)
    return _judged(cells, targets, allocate.centres(rings, 1000))


def _judged(cells: DataFrame, targets: DataFrame, centres: DataFrame) -> DataFrame:
    cells = cells.withColumns({"x": F.col("col").cast("double"), "y": F.col("row").cast("double")})
    maps = cells.select("map_id").distinct()
    if "map_id" not in centres.columns:  # one drawing for all maps of a geography
        centres = centres.join(by_merge(maps.withColumn("geo", F.split("map_id", "[|]")[0])), "geo")
    far = grid.drift(cells, centres.select("map_id", "region_id", "x", "y"), centres.select("map_id", "diagonal").distinct()).select("map_id", F.col("mean").alias("drift"), F.col("p95").alias("drift_p95"))
    round_ = grid.compactness(cells).select("map_id", "compactness")
    measures = _measures(cells, targets, F.lit(1000)).join(by_merge(round_), "map_id", "left").join(by_merge(far), "map_id", "left")
    return _rounded(measures, "mean_error", "compactness", "drift", "drift_p95")


def _degrees(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rings in degrees, weights, and the geographies' rules: a hundred parts are a land of ten by ten
    degrees with an oblique coast in the east, a lake, two regions off the west coast and one off the
    east, and one as small as a town within another. Lands have, by turns, a western inset or islands."""
    k = F.col("p_partkey")
    n = (k % BLOCK).cast("int")
    west, east = n.isin(80, 90), n == 9
    islands = F.floor(k / BLOCK) % 2 == 1
    code = F.when(islands & west, F.concat(F.lit("IS"), k.cast("string"))).when(islands & east, F.concat(F.lit("CY"), k.cast("string"))).otherwise(k.cast("string"))
    x = (n % 10).cast("double") - F.when(west, 16.0).when(east, -18.0).otherwise(0.0)
    parts = S.read(spark, sf_dir, "part").where(n != 55).select(
        F.concat(F.lit("b"), F.floor(k / BLOCK)).alias("geo"), code.alias("region_id"), k.alias("p_partkey"), k.cast("int").alias("feature_ord"),
        x.alias("_x"), (40.0 + F.floor(n / 10)).alias("_y"), n.alias("_n"),
    )
    at = lambda c, d: F.array(*[F.col(c) + float(v) for v in d])
    ring = lambda order, xs, ys: F.struct(F.lit(0).alias("poly_ord"), F.lit(order).alias("ring_ord"), at("_x", xs).alias("xs"), at("_y", ys).alias("ys"))
    square = ring(0, (0, 1, 1, 0), (0, 0, 1, 1))
    town = F.struct(F.lit(0).alias("poly_ord"), F.lit(0).alias("ring_ord"), at("_x", (-0.51, -0.49, -0.49, -0.51)).alias("xs"), at("_y", (0.49, 0.49, 0.51, 0.51)).alias("ys"))
    shapes = (
        F.when(F.col("_n") == 44, F.array(square, ring(1, (0.49, 0.51, 0.51, 0.49), (0.49, 0.49, 0.51, 0.51))))
        .when(F.col("_n") == 45, F.array(town))
        .when(F.col("_n") % 10 == 8, F.array(ring(0, (0, 1.4, 0.8, 0), (0, 0, 1, 1))))
        .otherwise(F.array(square))
    )
    rings = parts.select("geo", "region_id", "feature_ord", F.inline(shapes))
    weights = _last_year(spark, sf_dir, parts.select("geo", "region_id", k.alias("p_partkey")))
    odd = F.substring("geo", 2, 20).cast("long") % 2 == 1
    kinds = parts.select("geo").distinct().select("geo", F.when(odd, "islands").otherwise("west").alias("insets"), F.when(odd, "laea").otherwise("mercator").alias("projection"))
    return rings, written(weights, "weights"), kinds


@register("cartogram_insets")
def cartogram_insets(spark, sf_dir):
    """Cartograms from rings in degrees: projections, insets, coasts, a lake and a town without a cell."""
    rings, weights, kinds = _degrees(spark, sf_dir)
    return allocate.cartogram(weights, rings, 1000, kinds)[0]


@register("cartogram_insets_measures")
def cartogram_insets_measures(spark, sf_dir):
    rings, weights, kinds = _degrees(spark, sf_dir)
    drawn = written(geo.projected_maps(rings, kinds, weights), "drawn")  # once, for the cartogram and its measures
    cells, targets = allocate.cartogram(weights.withColumn("geo", F.col("map_id")), drawn, 1000)
    return _judged(cells, targets, allocate.centres(drawn, 1000).withColumnRenamed("geo", "map_id"))


def _measures(cells: DataFrame, targets: DataFrame, budget) -> DataFrame:
    error = grid.allocation_error(cells, targets).select("map_id", F.col("mean").alias("mean_error"))
    sizes = cells.groupBy("map_id").agg(F.count("*").alias("cells")).withColumn("budget", budget)
    return error.join(by_merge(sizes), "map_id").join(by_merge(grid.fragmentation(cells)), "map_id").withColumn("geo", F.split("map_id", "[|]")[0])


@register(
    "map_gates",
    f""", {CELLS}, {TARGETS}, {REACH}, {PIECES}, e AS (SELECT t.map_id, abs(count(c.col) - target) / target * 100 AS e FROM targets t LEFT JOIN cells c USING (map_id, region_id) WHERE target >= 3 GROUP BY t.map_id, t.region_id, target),
m AS (SELECT *, 900 AS budget FROM (SELECT map_id, avg(e) AS mean_error FROM e GROUP BY map_id) JOIN (SELECT map_id, count(*) AS cells FROM cells GROUP BY map_id) USING (map_id) JOIN pieces USING (map_id)),
p AS (SELECT map_id, 'allocation error' AS "check", format('{{}}|{{:.1f}}', map_id, mean_error) AS detail FROM m WHERE mean_error > 5
  UNION ALL SELECT map_id, 'tiles missing', format('{{}}|{{}}/{{}}', map_id, cells, budget) FROM m WHERE cells < 0.97 * budget UNION ALL SELECT map_id, 'fragmented', format('{{}}|{{}}/{{}}', map_id, fragmented, regions) FROM m WHERE fragmented > 0.15 * regions)
SELECT "check", map_id AS geo, CAST(NULL AS VARCHAR) AS indicator, CAST(NULL AS INTEGER) AS year, CAST(NULL AS VARCHAR) AS region_id, detail FROM p""",
)
def map_gates(spark, sf_dir):
    """The acceptance checks, of the grids of parts."""
    cells = cells_of_parts(spark, sf_dir)
    return quality.map_gates(_measures(cells, _targets(cells), F.lit(900)))


@register(
    "rasterize",
    f""", {LATTICE}, g AS (SELECT geo, min(x0) AS gx, max(x0) + 8 AS gx1, min(y0) AS gy, max(y0) + 8 AS gy1, sqrt(CAST(sum(CASE t WHEN 0 THEN 60 WHEN 1 THEN 48 WHEN 2 THEN 48 ELSE 64 END) AS DOUBLE) / 1000) AS side FROM lat GROUP BY geo),
n AS (SELECT *, CAST(ceil((gx1 - gx) / side) AS BIGINT) + 4 AS n_cols, CAST(ceil((gy1 - gy) / side) AS BIGINT) + 4 AS n_rows FROM g),
c AS (SELECT *, unnest(range(n_cols)) AS col FROM n), c2 AS (SELECT *, unnest(range(n_rows)) AS row FROM c),
p AS (SELECT geo, col, row, (col + 0.5 - 2) * side + gx AS x, (row + 0.5 - 2) * side + gy AS y FROM c2),
j AS (SELECT p.*, region_id, t, p.x - x0 AS a, p.y - y0 AS b FROM p JOIN lat ON lat.geo = p.geo AND lat.k = CAST(floor(p.x / 10) AS BIGINT) + {COLUMNS} * CAST(floor(p.y / 10) AS BIGINT) AND p.x >= 0 AND p.x < {10 * COLUMNS})
SELECT geo AS map_id, CAST(col AS INTEGER) AS col, CAST(row AS INTEGER) AS row, {r("x", 6)} AS x, {r("y", 6)} AS y, region_id FROM j WHERE a >= 0 AND a < 8 AND b >= 0 AND b < 8
  AND NOT (t = 0 AND a >= 3 AND a < 5 AND b >= 3 AND b < 5) AND NOT (t = 1 AND a >= 4 AND b >= 4) AND NOT (t = 2 AND a >= 3 AND a < 5)""",
)
def rasterize(spark, sf_dir):
    return _rounded(grid.rasterize(lattice(spark, sf_dir), 1000), "x", "y")


def _documents(spark, sf_dir) -> DataFrame:
    """JSON-stat cubes for each brand: indicator x geo x time, with some of the parts each."""
    p = S.fine_panel(spark, sf_dir).select(F.col("geo").alias("brand"), "indicator", F.col("region_id").alias("geo"), F.col("year").alias("time"), "value")
    docs = jsonstat.to_jsonstat(written(p, "cells"), ["brand"], ["indicator", "geo", "time"], split="geo").select(F.col("brand").alias("doc_id"), "json")
    return written(docs, "documents")  # read once for each dimension and for the values


@register("jsonstat_round_trip", "SELECT * FROM fine")
def jsonstat_round_trip(spark, sf_dir):
    return _as_panel(jsonstat.parse_jsonstat(_documents(spark, sf_dir)))


def _as_panel(cells: DataFrame) -> DataFrame:
    key = lambda d: F.try_element_at("key", F.lit(d))
    return cells.select(F.col("doc_id").alias("geo"), key("indicator").alias("indicator"), key("time").cast("int").alias("year"), key("geo").alias("region_id"), "value")


@register("jsonstat_files", "SELECT * FROM fine")
def jsonstat_files(spark, sf_dir):
    """The cubes as files, a document each, read in splits."""
    path = fresh_path(spark, "cubes")
    _documents(spark, sf_dir).repartition("doc_id").write.option("maxRecordsPerFile", 1).partitionBy("doc_id").text(path)
    return _as_panel(jsonstat.read_cells(spark, path))


@register("category_codes", "SELECT geo, CAST(year AS VARCHAR) AS code, CAST(row_number() OVER (PARTITION BY geo ORDER BY year) - 1 AS INTEGER) AS pos FROM (SELECT DISTINCT geo, year FROM fine)")
def category_codes(spark, sf_dir):
    labels = jsonstat.category_labels(_documents(spark, sf_dir)).where("dim = 'time'")
    return labels.select(F.col("doc_id").alias("geo"), "code", "pos").distinct()  # each cube of a brand has them


@register("resolve_pick", "SELECT geo AS doc_id, CAST(min(year) AS VARCHAR) AS code FROM fine WHERE year % 2 = 0 GROUP BY geo")
def resolve_pick(spark, sf_dir):
    labels = jsonstat.category_labels(_documents(spark, sf_dir)).where("dim = 'time'").distinct().withColumn("label", F.concat(F.lit("Year "), "code"))
    return panel.resolve_pick(labels, ["doc_id"], "^Year .*[02468]$")


@register("pin_dimensions", "SELECT geo, year, region_id, value FROM fine WHERE indicator = 'qty' AND year = 1997")
def pin_dimensions(spark, sf_dir):
    cells = jsonstat.parse_jsonstat(_documents(spark, sf_dir), {"indicator": "qty", "time": "1997"})
    key = lambda d: F.try_element_at("key", F.lit(d))
    return cells.select(F.col("doc_id").alias("geo"), key("time").cast("int").alias("year"), key("geo").alias("region_id"), "value")


@register(
    "build_panel",
    f""", v AS (SELECT geo, CASE indicator WHEN 'qty' THEN 'shipped' ELSE 'discount' END AS indicator, year, region_id, {r("value", 1)} AS value FROM fine),
ok AS (SELECT geo, indicator, year FROM v JOIN fine_n USING (geo) GROUP BY geo, indicator, year, n_regions HAVING count(*) >= ceil(n_regions * 0.6)) SELECT v.* FROM v JOIN ok USING (geo, indicator, year)""",
)
def build_panel(spark, sf_dir):
    region = S.fine_region(spark, sf_dir)
    made = F.array(*[F.struct(F.lit(n).alias("indicator"), F.create_map(F.lit("indicator"), F.lit(c)).alias("filter"), F.lit(1).alias("decimals")) for n, c in (("shipped", "qty"), ("discount", "avg_discount"))])
    metrics = region.select("geo").distinct().select("geo", F.col("geo").alias("dataset"), F.inline(made))
    cells = jsonstat.parse_pinned(_documents(spark, sf_dir).withColumnRenamed("doc_id", "dataset"), metrics)
    return panel.panel_of_cells(cells, region.select("geo", F.col("region_id").alias("src_code"), "region_id"), panel.region_counts(region))


@register("datasets_round_trip", "SELECT f.geo, f.indicator, f.year, f.region_id, f.value, kind, r.label FROM fine f JOIN fine_indicator USING (geo, indicator) JOIN fine_region r ON r.geo = f.geo AND r.region_id = f.region_id")
def datasets_round_trip(spark, sf_dir):
    files = datasets.datasets_json(written(S.fine_panel(spark, sf_dir), "panel"), S.fine_indicator(spark, sf_dir), S.fine_region(spark, sf_dir), most=1000)
    indicator, values, region = datasets.parse_datasets(files)
    rows = values.join(indicator.select("geo", "indicator", "kind").distinct(), ["geo", "indicator"]).join(region.select("geo", "region_id", "label"), ["geo", "region_id"])
    return rows.select("geo", "indicator", "year", "region_id", "value", "kind", "label")


@register(
    "datasets_rewrite",
    """, c AS (SELECT geo, region_id, label, '#' || lpad(CAST(CAST(region_id AS BIGINT) % 1000 AS VARCHAR), 6, '0') AS color FROM fine_region)
SELECT c.geo, c.region_id, c.label, CASE WHEN CAST(c.region_id AS BIGINT) % 2 = 0 THEN color END AS color, 'nightly' AS built_by, count(f.region_id) AS n
FROM c LEFT JOIN fine f ON f.geo = c.geo AND f.region_id = c.region_id AND f.indicator = 'qty' GROUP BY ALL""",
)
def datasets_rewrite(spark, sf_dir):
    """New values for files whose regions, with colours for some, are curated by hand."""
    region = S.fine_region(spark, sf_dir)
    code = F.col("region_id").cast("long")
    curated = region.withColumn("color", F.when(code % 2 == 0, F.concat(F.lit("#"), F.lpad((code % 1000).cast("string"), 6, "0"))))
    p, i = S.fine_panel(spark, sf_dir), S.fine_indicator(spark, sf_dir)
    existing = datasets.datasets_json(p.where("year = 1995"), i, curated, most=1000)
    meta = region.select("geo").distinct().select("geo", F.create_map(F.lit("builtBy"), F.lit("nightly")).alias("meta"))
    files = datasets.datasets_json(p, i, region.withColumn("label", F.lit("changed")), existing, meta, most=1000)
    _, values, kept = datasets.parse_datasets(files)
    counts = values.where("indicator = 'qty'").groupBy("geo", "region_id").agg(F.count("*").alias("n"))
    rows = kept.join(counts, ["geo", "region_id"], "left").join(datasets.parse_meta(files), "geo")
    return rows.select("geo", "region_id", "label", "color", F.col("meta")["builtBy"].alias("built_by"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
