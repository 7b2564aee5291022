"""Polygons as rings: areas, seeds, bounds, projections into a box, and points in polygons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.columns import array_mean, finite, laea, mercator, ring_area, route_inset
from tessella.functions.tables import by_merge, written

from .order import GROUPS_AT_MOST, large_groups

POLYGON = ["geo", "region_id", "feature_ord", "poly_ord"]


def valid_rings(ring: DataFrame) -> DataFrame:
    """Rings without their non-finite vertices; a ring needs three."""
    ok = lambda p: ~F.isnan(p["xs"]) & ~F.isnan(p["ys"]) & (F.abs(p["xs"]) != float("inf")) & (F.abs(p["ys"]) != float("inf"))
    points = F.filter(F.arrays_zip("xs", "ys"), lambda p: F.coalesce(ok(p), F.lit(False)))
    # not `where`: Spark would take that down to where xs and ys are worked out, and work them out again for it
    rows = ring.select(*POLYGON, "ring_ord", F.explode(F.filter(F.array(points), lambda p: F.size(p) >= 3)).alias("_p"))
    return rows.select(*POLYGON, "ring_ord", F.transform("_p", lambda p: p["xs"]).alias("xs"), F.transform("_p", lambda p: p["ys"]).alias("ys"))


def ring_measures(ring: DataFrame) -> DataFrame:
    """Area and vertex mean of each ring."""
    return ring.select(*POLYGON, "ring_ord", ring_area("xs", "ys").alias("area"), array_mean("xs").alias("cx"), array_mean("ys").alias("cy"))


def land_area(ring: DataFrame) -> DataFrame:
    """Outer rings less holes, for each geography."""
    area = ring_area("xs", "ys")
    return ring.groupBy("geo").agg(F.sum(F.when(F.col("ring_ord") == 0, area).otherwise(-area)).alias("area"))


def tile_side(ring: DataFrame, tiles: int) -> DataFrame:
    return land_area(ring).select("geo", F.sqrt(F.col("area") / tiles).alias("side"))


def region_seed(ring: DataFrame) -> DataFrame:
    """Vertex mean of each region's largest outer ring; of equal ones the first."""
    outer = ring.where("ring_ord = 0").select("geo", "region_id", F.struct(ring_area("xs", "ys").alias("a"), (-F.col("poly_ord")).alias("o")).alias("_k"), array_mean("xs").alias("x"), array_mean("ys").alias("y"))
    return outer.groupBy("geo", "region_id").agg(F.max_by("x", "_k").alias("x"), F.max_by("y", "_k").alias("y"))


def label_centroid(ring: DataFrame) -> DataFrame:
    """Vertex mean of the outer ring with the largest bounding box."""
    span = (F.array_max("xs") - F.array_min("xs")) * (F.array_max("ys") - F.array_min("ys"))
    outer = ring.where("ring_ord = 0").select("geo", "region_id", F.struct(span.alias("a"), (-F.col("poly_ord")).alias("o")).alias("_k"), array_mean("xs").alias("x"), array_mean("ys").alias("y"))
    return outer.groupBy("geo", "region_id").agg(F.max_by("x", "_k").alias("x"), F.max_by("y", "_k").alias("y"))


def bounds(ring: DataFrame, include: Column | None = None) -> DataFrame:
    """Extent of the outer rings of each geography, of all or of the regions that pass."""
    rows = ring.where("ring_ord = 0")
    rows = rows if include is None else rows.where(include)
    return rows.groupBy("geo").agg(
        F.min(F.array_min("xs")).alias("x0"), F.max(F.array_max("xs")).alias("x1"), F.min(F.array_min("ys")).alias("y0"), F.max(F.array_max("ys")).alias("y1")
    )


def project_rings(ring: DataFrame, projection: str) -> DataFrame:
    """Rings in projected coordinates, y downwards; `laea` or `mercator`."""
    to = laea if projection == "laea" else mercator
    points = F.transform(F.arrays_zip("xs", "ys"), lambda p: F.struct(*[c.alias(n) for c, n in zip(to(p["xs"], p["ys"]), ("x", "y"), strict=True)]))
    rows = ring.withColumn("_p", points)
    return valid_rings(rows.select(*POLYGON, "ring_ord", F.transform("_p", lambda p: p["x"]).alias("xs"), F.transform("_p", lambda p: -p["y"]).alias("ys")))


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def along_arcs(ring: DataFrame, to: Callable[[Column, Column], tuple[Column, Column]], deviation: Column) -> DataFrame:
    """Rings in degrees, projected by `to`, with points between the vertices where an edge bends.

    An edge is the great arc between two vertices. It is cut into so many pieces that none leaves
    its chord by more than about `deviation`, a column in projected units: the arc's distance from the
    chord at three points, which falls with the square of the number of pieces, gives that number.
    Points without a finite place go; edges that have such an end are not cut.
    """
    unit = lambda p: F.struct(
        (F.cos(F.radians(p["ys"])) * F.cos(F.radians(p["xs"]))).alias("a"), (F.cos(F.radians(p["ys"])) * F.sin(F.radians(p["xs"]))).alias("b"), F.sin(F.radians(p["ys"])).alias("c"),
        p["xs"].alias("lon"), p["ys"].alias("lat"),
    )
    pair = lambda lon, lat: F.struct(*[c.alias(n) for c, n in zip(to(lon, lat), ("x", "y"), strict=True)])

    def at(e: Column, t: Column | float) -> Column:
        """The place of the point at `t` of the chord; what is used more than once is named."""
        chord = F.struct(*[(e["p"][n] + t * (e["q"][n] - e["p"][n])).alias(n) for n in "abc"])
        place = _named(chord, lambda v: F.struct(F.degrees(F.atan2(v["b"], v["a"])).alias("lon"), F.degrees(F.atan2(v["c"], F.hypot(v["a"], v["b"]))).alias("lat")))
        return _named(place, lambda v: pair(v["lon"], v["lat"]))

    n = F.size("_v")
    rows = ring.withColumn("_v", F.transform(F.arrays_zip("xs", "ys"), unit))
    rows = rows.withColumn("_e", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("_v", i).alias("p"), F.get("_v", (i + 1) % n).alias("q"))))
    bent = lambda e: F.struct(
        e["p"].alias("p"), e["q"].alias("q"), pair(e["p"]["lon"], e["p"]["lat"]).alias("from"), pair(e["q"]["lon"], e["q"]["lat"]).alias("to"), *[at(e, t).alias(k) for k, t in QUARTERS]
    )
    off = lambda e, k, t: F.hypot(e[k]["x"] - e["from"]["x"] - t * (e["to"]["x"] - e["from"]["x"]), e[k]["y"] - e["from"]["y"] - t * (e["to"]["y"] - e["from"]["y"]))
    most = lambda e: F.greatest(*[off(e, k, t) / (4 * t * (1 - t)) for k, t in QUARTERS])
    count = lambda e: _named(most(e), lambda m: F.when(finite(m), F.greatest(F.coalesce(F.ceil(F.sqrt(F.try_divide(m, deviation))), F.lit(1)), F.lit(1))).otherwise(1).cast("int"))
    rows = rows.withColumn("_e", F.transform("_e", bent)).withColumn("_e", F.transform("_e", lambda e: F.struct(e["p"].alias("p"), e["q"].alias("q"), e["from"].alias("from"), count(e).alias("n"))))
    more = lambda e: F.concat(F.array(e["from"]), F.when(e["n"] > 1, F.transform(F.sequence(F.lit(1), F.greatest(e["n"] - 1, F.lit(1))), lambda k: at(e, k / e["n"]))).otherwise(F.array().cast("array<struct<x:double,y:double>>")))
    rows = rows.withColumn("_p", F.flatten(F.transform("_e", more)))
    return valid_rings(rows.select(*POLYGON, "ring_ord", F.transform("_p", lambda p: p["x"]).alias("xs"), F.transform("_p", lambda p: p["y"]).alias("ys")))


#: Where an arc's distance from its chord is looked at.
QUARTERS = (("m1", 0.25), ("m2", 0.5), ("m3", 0.75))


def fit_extent(ring: DataFrame, boxes: DataFrame, include: DataFrame | None = None, outline: DataFrame | None = None) -> DataFrame:
    """Scales and centres the rings of each (geo, inset) into its box, keeping the aspect.

    boxes(geo, inset, bx0, by0, bx1, by1, least): see inset_boxes(). The fit follows the
    regions in `include` (geo, region_id) if the geography has at least `least` of them, else
    (or where least is null) all regions. Extents are those of `outline`, the same rings with more
    points, if there is one.
    """
    drawn = include.distinct().withColumn("_drawn", F.lit(True)) if include is not None else None
    outer = (ring if outline is None else outline).where("ring_ord = 0").join(by_merge(boxes), ["geo", "inset"])
    if drawn is None:
        counted = outer.withColumns({"_drawn": F.lit(None).cast("boolean"), "_n": F.lit(0)})
    else:
        n = ring.select("geo", "region_id").distinct().join(by_merge(drawn), ["geo", "region_id"]).groupBy("geo").agg(F.count("*").alias("_n"))
        counted = outer.join(by_merge(drawn), ["geo", "region_id"], "left").join(by_merge(n), "geo", "left")
    follows = F.coalesce((F.col("_n") >= F.col("least")), F.lit(False))
    ends = counted.where(~follows | F.col("_drawn")).groupBy("geo", "inset").agg(
        F.min(F.array_min("xs")).alias("x0"), F.max(F.array_max("xs")).alias("x1"), F.min(F.array_min("ys")).alias("y0"), F.max(F.array_max("ys")).alias("y1"),
        *[F.first(c).alias(c) for c in ("bx0", "by0", "bx1", "by1")],
    )
    k = F.least(F.try_divide(F.col("bx1") - F.col("bx0"), F.col("x1") - F.col("x0")), F.try_divide(F.col("by1") - F.col("by0"), F.col("y1") - F.col("y0")))
    middle = lambda b, v: (F.col(f"b{v}0") + F.col(f"b{v}1")) / 2 - b * (F.col(f"{v}0") + F.col(f"{v}1")) / 2
    fit = ends.select("geo", "inset", k.alias("_k"), middle(k, "x").alias("_tx"), middle(k, "y").alias("_ty"))
    rows = ring.join(by_merge(fit), ["geo", "inset"])
    return rows.select(*POLYGON, "ring_ord", "inset", F.transform("xs", lambda x: x * F.col("_k") + F.col("_tx")).alias("xs"), F.transform("ys", lambda y: y * F.col("_k") + F.col("_ty")).alias("ys"))


def inset_of(ring: DataFrame, geography: DataFrame) -> DataFrame:
    """The inset of each region, by the rules of its geography (geo, insets)."""
    least = ring.groupBy("geo", "region_id").agg(F.min(F.array_min("xs")).alias("_lon"))
    return least.join(by_merge(geography.select("geo", "insets")), "geo").select("geo", "region_id", route_inset("insets", "region_id", "_lon").alias("inset"))


def _clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def inset_box(share: Column, width: float, height: float) -> tuple[Column, Column]:
    """Width and height of the western inset, whose area follows its share of the weight (0.05
    if unknown) within bounds."""
    # margins, bounds and the aspect are fixed values
    usable = (width - 22) * (height - 96)
    area = _clamp(F.coalesce(share, F.lit(0.05)) * usable * 1.35, usable * 0.04, usable * 0.26)
    w = _clamp(F.sqrt(area * 1.7), width * 0.2, width * 0.56)
    return w, _clamp(area / w, height * 0.1, height * 0.3)


def inset_boxes(maps: DataFrame, width: float, height: float) -> DataFrame:
    """maps(geo, insets, share) -> (geo, inset, bx0, by0, bx1, by1, least): the boxes of each
    map, with margins left free, and how many regions must be drawn for a fit to follow them."""
    w, h = inset_box(F.col("share"), width, height)
    iw, ih = width * 0.06, height * 0.07  # fixed values, as are the margins below
    box = lambda inset, x0, y0, x1, y1, least: F.struct(
        F.lit(inset).alias("inset"), *[(v if isinstance(v, Column) else F.lit(float(v))).alias(n) for n, v in (("bx0", x0), ("by0", y0), ("bx1", x1), ("by1", y1))],
        F.lit(least).cast("int").alias("least"),
    )
    west = F.array(box("main", 10, 62, width - 10, height - h - 60, 1), box("canaries", 12, height - h - 34, 12 + w, height - 34, 1))
    islands = F.array(
        box("main", 10, 62, width - 10, height - 14, 9), box("iceland", 14, 66, 14 + iw, 66 + ih, None),
        box("east", width - 14 - iw, height - 30 - ih, width - 14, height - 30, None),
    )
    plain = F.array(box("main", 10, 62, width - 10, height - 30, 1))
    return maps.select("geo", F.inline(F.when(F.col("insets") == "west", west).when(F.col("insets") == "islands", islands).otherwise(plain)))


def dorling_radius(weights: DataFrame, width: float = 900, height: float = 780) -> DataFrame:
    """Radius of each region's circle: areas proportional to positive weights, at least 2.5."""
    weights = weights.where(finite("w") & (F.col("w") > 0))
    total = weights.groupBy("map_id").agg(F.sum("w").alias("_total"))
    k = 0.42 * (width - 40) * (height - 120) / F.col("_total")
    return weights.join(by_merge(total), "map_id").select("map_id", "region_id", "w", F.greatest(F.lit(2.5), F.sqrt(F.col("w") * k / F.pi())).alias("radius"))


def scale_polygons(ring: DataFrame, weights: DataFrame) -> DataFrame:
    """Rings shrunk about their region's label point, so that areas follow the positive weights
    (geo, region_id, w)."""
    weights = weights.where(finite("w") & (F.col("w") > 0))
    top = weights.groupBy("geo").agg(F.max("w").alias("_max"))
    k = weights.join(by_merge(top), "geo").select("geo", "region_id", F.sqrt(F.col("w") / F.col("_max")).alias("_k"))
    centre = label_centroid(ring).withColumnsRenamed({"x": "_cx", "y": "_cy"})
    rows = ring.join(by_merge(k), ["geo", "region_id"]).join(by_merge(centre), ["geo", "region_id"])
    move = lambda a, c: F.transform(a, lambda v: F.col(c) + (v - F.col(c)) * F.col("_k"))
    return rows.select(*POLYGON, "ring_ord", move("xs", "_cx").alias("xs"), move("ys", "_cy").alias("ys"))


def points_in_polygons(points: DataFrame, ring: DataFrame, point_id: list[str], bucket: float, at_once: int = 1 << 18) -> DataFrame:
    """points(point_id.., geo, x, y) with the region of the first feature that holds them.

    Both sides are dealt to squares of side `bucket`: a polygon to all that its box meets, a
    point to one; each square gets just the edges that cross its band of y. Even-odd test with
    half-open edges over all rings of a polygon, so that holes are outside. Points in no
    polygon go; rows that repeat a point stay as many. Squares of more than `at_once` points (and
    a 4096th of all) are dealt to several tasks: their polygons are sent to each, some 8192 in all.
    """
    n = F.size("xs")
    edges = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            F.get("xs", i).alias("x1"), F.get("ys", i).alias("y1"), F.get("xs", (i + 1) % n).alias("x2"), F.get("ys", (i + 1) % n).alias("y2")
        ),
    )
    rings = ring.where(n > 2).select(*POLYGON, edges.alias("_e"), *[f(F.col(c)).alias(o) for f, c, o in ((F.array_min, "xs", "_x0"), (F.array_max, "xs", "_x1"), (F.array_min, "ys", "_y0"), (F.array_max, "ys", "_y1"))])
    polys = rings.groupBy(*POLYGON).agg(F.flatten(F.collect_list("_e")).alias("_edges"), F.min("_x0").alias("_x0"), F.max("_x1").alias("_x1"), F.min("_y0").alias("_y0"), F.max("_y1").alias("_y1"))
    cell = lambda c: F.floor(F.col(c) / bucket)
    polys = polys.withColumn("_bx", F.explode(F.sequence(cell("_x0"), cell("_x1")))).withColumn("_by", F.explode(F.sequence(cell("_y0"), cell("_y1"))))
    low = F.col("_by") * F.lit(bucket)
    band = F.filter("_edges", lambda e: (F.least(e["y1"], e["y2"]) <= low + bucket) & (F.greatest(e["y1"], e["y2"]) >= low))
    polys = polys.select(*POLYGON, band.alias("_edges"), "_bx", "_by")
    square = ["geo", "_bx", "_by"]
    placed = points.withColumn("_bx", cell("x")).withColumn("_by", cell("y"))
    crowded = large_groups(placed, square, at_once)
    at = square if crowded is None else [*square, "_deal"]
    if crowded is None:
        pairs = placed.join(by_merge(polys), at)
    else:
        share = max(at_once, placed.count() // GROUPS_AT_MOST)
        crowded = F.broadcast(crowded.select(*square, F.ceil(F.col("_size") / share).cast("int").alias("_deals")))
        deals, mine = F.coalesce("_deals", F.lit(1)), F.pmod(F.xxhash64(*point_id, "x", "y"), F.coalesce("_deals", F.lit(1))).cast("int")
        dealt = placed.join(crowded, square, "left").withColumn("_deal", mine).drop("_deals")
        each = polys.join(crowded, square, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("_deals")
        pairs = dealt.join(by_merge(each), at)
    x, y = F.col("x"), F.col("y")
    def crosses(e: Column) -> Column:
        """Whether the edge crosses the ray to the right of the point, without a division."""
        left, right = (x - e["x2"]) * (e["y1"] - e["y2"]), (e["x1"] - e["x2"]) * (y - e["y2"])
        return ((e["y1"] > y) != (e["y2"] > y)) & F.when(e["y1"] > e["y2"], left < right).otherwise(left > right)

    crossing = F.filter("_edges", crosses)
    place = F.struct(F.col("feature_ord").alias("f"), F.col("poly_ord").alias("p"), F.col("region_id").alias("r"))
    # a point has one square and deal: with them as keys, its rows are grouped where the join left them
    one = list(dict.fromkeys([*at, *point_id, "x", "y"]))
    hits = pairs.where(F.size(crossing) % 2 == 1).groupBy(*one, place.alias("_at")).agg(F.count("*").alias("_n"))
    first = hits.groupBy(*one).agg(F.min(F.struct("_at", "_n")).alias("_first"))
    return first.select(*point_id, F.col("_first._at.r").alias("region_id"), F.explode(F.sequence(F.lit(1), F.col("_first._n"))).alias("_k")).drop("_k")


def nearest_cell(points: DataFrame, cells: DataFrame, by: str, point_id: list[str], bucket: float = 8.0, at_once: int = 256) -> DataFrame:
    """The cell of the same `by` nearest to each point, ties to the least (col, row).

    Cells lie in square buckets. A point looks at the buckets around its own, then at rings of twice the
    width, and so on, until some bucket there has cells: the far corner of one bounds the distance. Of the
    buckets no farther than that bound, the cells are compared. Only buckets are met in search, and only cells of near buckets at the end,
    so no map's cells meet all its points; they do so in arrays of at most `at_once`, of each of which only the
    nearest cell becomes a row. Points of a map without cells, or of no finite place, have no row;
    points that repeat have one.
    """
    place = lambda c: F.floor(F.col(c) / bucket).alias(f"_b{c}")
    left = written(points.where(finite("x") & finite("y")).select(by, *point_id, "x", "y").distinct(), "points")
    if not left.head(1):
        return points.join(by_merge(cells.select(by, "col", "row")), by).select(by, *point_id, "col", "row").limit(0)
    inside = cells.where(finite("x") & finite("y")).select(by, "col", "row", F.col("x").alias("_x"), F.col("y").alias("_y"), place("x"), place("y"))
    square = [by, "_bx", "_by"]
    part = F.floor((F.row_number().over(W.partitionBy(*square).orderBy("col", "row")) - 1) / at_once)
    packed = inside.withColumn("_part", part).groupBy(*square, "_part").agg(F.collect_list(F.struct("_x", "_y", "col", "row")).alias("_cells"))
    packed = written(packed.drop("_part"), "packed")
    full = written(packed.select(*square).distinct(), "buckets")
    left = written(left.join(by_merge(full.select(by).distinct()), by, "left_semi"), "points")
    found, level = None, 0
    key = [by, *point_id, "x", "y"]

    def around(rows: DataFrame, level: int) -> DataFrame:
        """Rows of points with the buckets of cells in the 3 x 3 squares of 2^level buckets about them."""
        wide = bucket * 2.0**level
        step = lambda c, o: (F.floor(F.col(c) / wide) + F.col(o)).alias(f"_n{c}")
        near = rows.withColumn("_i", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))).withColumn("_j", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])))
        near = near.select(*rows.columns, step("x", "_i"), step("y", "_j"))
        coarse = full.select(by, "_bx", "_by", *[F.floor(F.col(f"_b{c}") / 2.0**level).alias(f"_n{c}") for c in "xy"])
        return near.join(by_merge(coarse), [by, "_nx", "_ny"])

    def off(c: str, far: bool) -> Column:
        """How far the bucket's far, or near, side is from the point along an axis."""
        low, v = F.col(f"_b{c}") * bucket, F.col(c)
        a, b = low - v, v - low - bucket
        return F.greatest(-a, -b) if far else F.greatest(a, b, F.lit(0.0))

    while left.head(1):
        reach = around(left, level).groupBy(*key).agg(F.min(F.hypot(off("x", True), off("y", True))).alias("_reach"))
        reach = written(reach, "reach")
        # the bound is at most 2 sqrt(2) squares: nothing nearer lies outside the squares of four times the width
        near = around(reach, level + 2).where(F.hypot(off("x", False), off("y", False)) <= F.col("_reach") * (1 + 1e-9))
        pairs = near.select(*key, "_bx", "_by").join(by_merge(packed), square)
        d = lambda c: (F.col("x") - c["_x"]) * (F.col("x") - c["_x"]) + (F.col("y") - c["_y"]) * (F.col("y") - c["_y"])
        nearest = F.array_min(F.transform("_cells", lambda c: F.struct(d(c).alias("d"), c["col"].alias("col"), c["row"].alias("row"))))
        best = pairs.select(*key, nearest.alias("_near")).groupBy(*key).agg(F.min("_near").alias("_best"))
        best = best.select(by, *point_id, "_best.col", "_best.row")
        found = best if found is None else found.unionByName(best)
        left, level = written(left.join(by_merge(reach), key, "left_anti"), "points"), level + 1
    if found is None:
        return points.join(by_merge(cells.select(by, "col", "row")), by).select(by, *point_id, "col", "row").limit(0)
    return found


#: Where each projection is centred, by geography and inset: longitude, latitude. Fixed values.
CENTRES = {("laea", "main"): (15.0, 54.0), ("laea", "inset"): (0.0, 0.0)}


def projected_maps(ring: DataFrame, geography: DataFrame, weights: DataFrame, width: float = 900, height: float = 780) -> DataFrame:
    """Rings in degrees, drawn for each map: ring table with geo = map_id and the inset of each region.

    geography(geo, insets, projection): the rules of its insets, and `laea` or `mercator`;
    weights(map_id, geo, region_id, w). Regions are routed to their insets, projected (an inset of
    `laea` about (0, 0)), and fitted to the boxes of their map: the western one's size follows
    its share of the map's positive weights, and a fit follows the regions with a positive weight. It
    measures the edges as great arcs, to a hundredth of a pixel; the rings keep their vertices. Vertices that are no
    number, or have no finite place in the projection, go, and rings of fewer than three with them.
    """
    ring = valid_rings(ring)
    drawn = weights.where(finite("w") & (F.col("w") > 0))
    inset = written(inset_of(ring, geography), "insets")
    rows = ring.join(by_merge(inset), ["geo", "region_id"]).join(by_merge(geography.select("geo", "projection")), "geo")
    centre = lambda i: F.when(F.col("inset") == "main", CENTRES["laea", "main"][i]).otherwise(CENTRES["laea", "inset"][i])
    equal = F.col("projection") == "laea"

    def to(lon: Column, lat: Column) -> tuple[Column, Column]:
        (ax, ay), (mx, my) = laea(lon, lat, centre(0), centre(1)), mercator(lon, lat)
        return F.when(equal, ax).otherwise(mx), -F.when(equal, ay).otherwise(my)

    points = F.transform(F.arrays_zip("xs", "ys"), lambda p: F.struct(*[c.alias(n) for c, n in zip(to(p["xs"], p["ys"]), "xy", strict=True)]))
    made = rows.withColumn("_p", points)
    made = made.select(*POLYGON, "ring_ord", F.transform("_p", lambda p: p["x"]).alias("xs"), F.transform("_p", lambda p: p["y"]).alias("ys"))
    flat = written(valid_rings(made), "projected")
    # a hundredth of a pixel, where the extent of the vertices fills the width
    reach = lambda c: F.max(F.array_max(c)) - F.min(F.array_min(c))
    span = flat.join(by_merge(inset), ["geo", "region_id"]).groupBy("geo", "inset").agg((F.greatest(reach("xs"), reach("ys")) / (100 * max(width, height))).alias("_hair"))
    outline = written(along_arcs(rows.where("ring_ord = 0").join(by_merge(span), ["geo", "inset"]), to, F.col("_hair")), "outline")
    west = drawn.join(by_merge(inset), ["geo", "region_id"]).groupBy("map_id").agg((F.sum(F.when(F.col("inset") == "canaries", F.col("w")).otherwise(0.0)) / F.sum("w")).alias("share"))
    maps = weights.select("map_id", "geo").distinct().join(by_merge(west), "map_id", "left").join(by_merge(geography.select("geo", "insets")), "geo")
    boxes = inset_boxes(maps.select(F.col("map_id").alias("geo"), "insets", F.coalesce("share", F.lit(0.0)).alias("share")), width, height)
    each = lambda rings: rings.join(by_merge(inset), ["geo", "region_id"]).join(by_merge(maps.select("map_id", "geo")), "geo").drop("geo").withColumnRenamed("map_id", "geo")
    return fit_extent(each(flat), boxes, drawn.select(F.col("map_id").alias("geo"), "region_id"), each(outline))
