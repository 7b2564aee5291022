import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.tables import written
from tessella.jobs import map_queries
from tessella.operators import allocate, geo, grid, order

CELL = "map_id string, col int, row int, region_id string"


def around(c, s):
    return [(c[0] + a, c[1] + b) for a, b in grid.AROUND if (c[0] + a, c[1] + b) in s]


def pieces(cells):
    """Each cell's component: its least cell."""
    out, left = {}, set(cells)
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            c = todo.pop()
            seen.add(c)
            todo += [n for n in around(c, left)]
            left -= set(todo)
        out |= dict.fromkeys(seen, min(seen))
    return out


@pytest.fixture(scope="module")
def maps():
    rng = random.Random(4)
    out = {}
    for m in range(4):
        n = rng.randint(5, 14)
        out[f"m{m}"] = {(c, r): rng.choice("abc") for c in range(n) for r in range(n) if rng.random() < 0.35 + 0.2 * m}
    # a ring with a hole of several cells, a bay open to the sea, and cells that touch at corners only
    out["ring"] = {(c, r): "ab"[c > 2] for c in range(7) for r in range(6) if c in (0, 6) or r in (0, 5)} | {(10, 10): "a", (11, 11): "b"}
    out["bay"] = {(c, r): "a" for c in range(4) for r in range(4) if not (c == 1 and r >= 1)}
    # a snake as long as the map has cells, two combs that meet in the last column, and a map of columns apart
    out["snake"] = {(c, r): "a" for c in range(15) for r in range(5) if c % 2 == 0 or r == (0 if c % 4 == 1 else 4)}
    out["combs"] = {(c, r): "b" for c in range(14) for r in range(9) if r % 2 == 0 or c == 13}
    out["apart"] = {(c, r): "c" for c in range(0, 20, 3) for r in range(0, 9, 2)}
    return out


def table(spark, maps):
    return spark.createDataFrame([(m, c, r, x) for m, cells in maps.items() for (c, r), x in cells.items()], CELL)


@pytest.mark.parametrize(("at_once", "fan"), [(200_000, 16), (5, 16), (3, 2)])
def test_components(spark, maps, monkeypatch, at_once, fan):
    """Components, however many blocks a map is cut into and joined at once, are those of a flood fill."""
    monkeypatch.setattr(grid, "RUNS_AT_ONCE", at_once)
    monkeypatch.setattr(grid, "FAN", fan)
    for by in (None, ["region_id"]):
        want = {}
        for m, cells in maps.items():
            for group in [set(cells)] if by is None else [{c for c in cells if cells[c] == x} for x in "abc"]:
                want |= {(m, *c): (least[0] << 20) + least[1] for c, least in pieces(group).items()}
        found = grid.grid_components(table(spark, maps), by).collect()
        assert {(r.map_id, r.col, r.row): r.component for r in found} == want and len(found) == len(want)


def test_fragmentation(spark, maps):
    found = {r.map_id: (r.regions, r.fragmented) for r in grid.fragmentation(table(spark, maps)).collect()}
    for m, cells in maps.items():
        regions = set(cells.values())
        split = sum(len(set(pieces({c for c in cells if cells[c] == x}).values())) > 1 for x in regions)
        assert found[m] == (len(regions), split)


def test_enclosed_cells_are_filled_row_by_row(spark, maps):
    found = {}
    for r in grid.fill_enclosed(table(spark, maps)).collect():
        assert (r.col, r.row) not in found.setdefault(r.map_id, {})
        found[r.map_id][r.col, r.row] = r.region_id
    for m, cells in maps.items():
        cols, rows = zip(*cells, strict=True)
        box = {(c, r) for c in range(min(cols) - 1, max(cols) + 2) for r in range(min(rows) - 1, max(rows) + 2)}
        part = pieces(box - set(cells))
        sea, want = part[min(cols) - 1, min(rows) - 1], dict(cells)
        for c, r in sorted(part, key=lambda c: (c[1], c[0])):
            if part[c, r] != sea:
                near = [want[n] for n in around((c, r), want)]
                want[c, r] = min(set(near), key=lambda x: (-near.count(x), x))
        assert found[m] == want
    assert (1, 1) not in found["bay"] and (3, 3) in found["ring"]


def test_open_cell(spark, maps):
    found = {(r.map_id, r.region_id): (r.col, r.row, r.width, r.height) for r in grid.open_cell(table(spark, maps)).collect()}
    for m, cells in maps.items():
        for x in set(cells.values()):
            own = {c for c in cells if cells[c] == x}

            def run(c, a, b):
                return next(n for n in range(99) if (c[0] + (n + 1) * a, c[1] + (n + 1) * b) not in own)

            room = {c: (2 * min(run(c, -1, 0), run(c, 1, 0)) + 1, 2 * min(run(c, 0, -1), run(c, 0, 1)) + 1) for c in own}
            best = max(own, key=lambda c: (min(room[c][0], 3.2 * room[c][1]), -c[1], -c[0]))
            assert found[m, x] == (*best, *room[best])


def test_assignment_is_the_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n, k = int(rng.integers(3, 8)), int(rng.integers(1, 4))
        xy, seeds = rng.integers(0, 4, (n, 2)).astype(float), rng.uniform(0, 4, (k, 2))
        budget = np.bincount(rng.integers(0, k, n), minlength=k)
        d = ((xy[:, None] - seeds[None]) ** 2).sum(2)
        owners = [o for o in itertools.product(range(k), repeat=n) if (np.bincount(o, minlength=k) == budget).all()]
        owner = allocate.capacitated_assign(xy, seeds, budget)
        assert (np.bincount(owner, minlength=k) == budget).all()
        assert d[np.arange(n), owner].sum() <= min(d[np.arange(n), o].sum() for o in owners) + 1e-9


def test_resize_and_shrink():
    square = {(c, r) for c in range(5) for r in range(5)}
    for size in (1, 7, 24, 25, 40):
        assert len(allocate.resize_cells(square, square, size)) == size
    smaller = allocate.resize_cells(square, square, 20)
    assert smaller < square and {(c, r) for c in range(1, 4) for r in range(1, 4)} <= smaller
    walls = square | {(c, r) for c in range(-1, 6) for r in range(-1, 6)}
    assert allocate.resize_cells(square, walls, 30) == square  # no room
    assert allocate.shrunk(np.array([5, 3, 2]), 5).tolist() == [3, 1, 1] and allocate.shrunk(np.array([1, 1, 1]), 2).tolist() == [1, 1, 0]


def test_cartogram_gives_each_region_its_budget(spark):
    boxes = [(f"r{c}{r}", 10.0 * c, 10.0 * r) for c in range(4) for r in range(4)]
    rings = spark.createDataFrame(
        [("g", i, k, 0, 0, [x, x + 10, x + 10, x], [y, y, y + 10, y + 10]) for k, (i, x, y) in enumerate(boxes)],
        "geo string, region_id string, feature_ord int, poly_ord int, ring_ord int, xs array<double>, ys array<double>",
    )
    rng = random.Random(1)
    weights = [(m, "g", i, rng.choice([1.0, 2.0, 9.0, 30.0])) for m in ("a", "b") for i, _, _ in boxes] + [("a", "g", "r99", -1.0)]
    cells, targets = allocate.cartogram(spark.createDataFrame(weights, "map_id string, geo string, region_id string, w double"), rings, 300)
    got = {(r.map_id, r.region_id): r["count"] for r in cells.groupBy("map_id", "region_id").count().collect()}
    assert got == {(r.map_id, r.region_id): r.target for r in targets.collect() if r.target} and sum(got.values()) == 600
    assert all(r.fragmented <= 0.15 * r.regions for r in grid.fragmentation(cells).collect())


def test_no_step_of_a_map_is_broadcast(spark):
    """Files of cells are small beside their rows, so that their size must not decide on a broadcast."""
    rings = spark.createDataFrame([("g", "r", 0, 0, 0, [0.0, 9.0, 9.0, 0.0], [0.0, 0.0, 9.0, 9.0])], "geo string, region_id string, feature_ord int, poly_ord int, ring_ord int, xs array<double>, ys array<double>")
    weights = spark.createDataFrame([("g|1", "g", "r", 1.0)], "map_id string, geo string, region_id string, w double")
    kinds = spark.createDataFrame([("g", "west", "mercator")], "geo string, insets string, projection string")
    cells = spark.createDataFrame([("g", 0, 0, 0.5, 0.5, "r", 0)], "map_id string, col int, row int, x double, y double, region_id string, component long")
    targets, seeds = weights.select("map_id", "region_id", F.lit(3).alias("target")), weights.select("map_id", "region_id", F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    placed = grid.region_placement(cells, targets, seeds)
    steps = [grid.rasterize(rings, 4), grid.fill_enclosed(cells), grid.grid_components(cells), allocate.centres(rings, 4), placed, grid.component_budget(placed, targets), geo.projected_maps(rings, kinds, weights), grid.allocation_error(cells, targets)]
    assert not [k for k, df in enumerate(steps) if "Broadcast" in df._jdf.queryExecution().executedPlan().toString()]


@pytest.mark.parametrize("query", ["cartogram", "cartogram_sizes", "cartogram_measures"])
def test_no_table_of_a_cartogram_query_is_broadcast(spark, tmp_path, monkeypatch, query):
    """All tables that the query writes, and its result; the assignment is a cheap one."""
    lines = [(k, float(1 + k * 7 % 50), 0.01 * (k % 7), f"199{7 + k % 2}-03-01") for k in range(200)]
    lines = spark.createDataFrame(lines, "l_partkey long, l_quantity double, l_discount double, day string")
    lines.select("l_partkey", "l_quantity", "l_discount", F.to_timestamp("day").alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(200).select(F.col("id").alias("p_partkey"), F.lit("Brand#11").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    plans = []

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, name)

    for module in (allocate, geo, grid, order, map_queries):
        monkeypatch.setattr(module, "written", seen)
    monkeypatch.setattr(allocate, "allocate", lambda cells, plan: cells.join(plan.groupBy("map_id", "component").agg(F.min("region_id").alias("region_id")).hint("merge"), ["map_id", "component"]).select("map_id", "col", "row", "component", "region_id"))
    seen(getattr(map_queries, query)(spark, str(tmp_path)), "result")
    assert len(plans) > 10 and not [name for name, plan in plans if "Broadcast" in plan]


def test_points_that_repeat_stay(spark):
    rings = spark.createDataFrame(
        [("g", "first", 0, 0, 0, [0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 4.0, 4.0]), ("g", "hole", 1, 0, 0, [3.0, 9.0, 9.0, 3.0], [0.0, 0.0, 9.0, 9.0]), ("g", "hole", 1, 0, 1, [5.0, 7.0, 7.0, 5.0], [5.0, 5.0, 7.0, 7.0])],
        "geo string, region_id string, feature_ord int, poly_ord int, ring_ord int, xs array<double>, ys array<double>",
    )
    points = [(1, 3.5, 1.0), (1, 3.5, 1.0), (1, 8.0, 8.0), (2, 6.0, 6.0), (3, 20.0, 1.0), (None, 1.0, 1.0)]
    found = geo.points_in_polygons(spark.createDataFrame([(i, "g", x, y) for i, x, y in points], "id long, geo string, x double, y double"), rings, ["id"], 2.0)
    assert sorted(((r.id, r.region_id) for r in found.collect()), key=str) == sorted([(1, "first"), (1, "first"), (1, "hole"), (None, "first")], key=str)


def test_nothing_to_do(spark):
    empty = spark.createDataFrame([], CELL)
    assert grid.grid_components(empty).count() == 0 and grid.fill_enclosed(empty).count() == 0 and grid.open_cell(empty).count() == 0


def test_workers_find_the_package(spark, monkeypatch):
    from pathlib import Path

    from tessella.functions.tables import importable

    root = str(Path(__file__).resolve().parents[1])
    monkeypatch.setitem(spark.sparkContext.environment, "PYTHONPATH", "/elsewhere")
    importable(spark)
    importable(spark)
    assert spark.sparkContext.environment["PYTHONPATH"].split(":") == [root, "/elsewhere"]


def test_nearest_cell_across_gaps(spark):
    """Against all pairs: gaps wider than a bucket, ties, cells left of zero, a map without cells."""
    rng = random.Random(5)
    cells = [("a", c, r, float(c), float(r)) for c, r in {(rng.randrange(-30, 30), rng.randrange(-30, 30)) for _ in range(200)}] + [("a", 500, 500, 500.0, 500.0), ("b", 3, 4, 3.0, 4.0)]
    points = [("a", k, rng.uniform(-60, 60), rng.uniform(-60, 60)) for k in range(60)] + [("a", 60, 300.0, 290.0), ("a", 61, 0.5, 0.5), ("b", 1, 900.0, -700.0), ("c", 1, 0.0, 0.0), ("a", 62, float("nan"), 0.0), ("a", 61, 0.5, 0.5)]
    got = geo.nearest_cell(spark.createDataFrame(points, "m string, k int, x double, y double"), spark.createDataFrame(cells, "m string, col int, row int, x double, y double"), "m", ["k"])
    found = {(r.m, r.k): (r.col, r.row) for r in got.collect()}
    want = {(m, k): min(((x - cx) ** 2 + (y - cy) ** 2, c, r) for n, c, r, cx, cy in cells if n == m)[1:] for m, k, x, y in points if m != "c" and x == x}
    assert found == want and got.count() == len(want)
    none = spark.createDataFrame([], "m string, col int, row int, x double, y double")
    assert geo.nearest_cell(spark.createDataFrame(points, "m string, k int, x double, y double"), none, "m", ["k"]).count() == 0


@pytest.mark.parametrize("at_once", [1, 7, 256])
def test_nearest_cell_meets_cells_in_arrays(spark, at_once):
    """Full buckets, in arrays of any size: a pair is a point with an array, not with each cell; ties to the least (col, row)."""
    cells = spark.createDataFrame([("a", c, r, float(c), float(r)) for c in range(16) for r in range(16)], "m string, col int, row int, x double, y double")
    points = [("a", k, k % 40 / 2 - 2, k // 40 + 0.5) for k in range(400)]
    found = geo.nearest_cell(spark.createDataFrame(points, "m string, k int, x double, y double"), cells, "m", ["k"], at_once=at_once)
    want = {k: min(((x - c) ** 2 + (y - r) ** 2, c, r) for c in range(16) for r in range(16))[1:] for _, k, x, y in points}
    assert {r.k: (r.col, r.row) for r in found.collect()} == want and found.count() == 400
    assert "array_min(transform(_cells" in found._jdf.queryExecution().optimizedPlan().toString()


def test_resize_is_one_cell_at_a_time():
    rng = random.Random(1)

    def slowly(cells, taken, size):
        cells = set(cells)
        count = lambda c: sum(n in cells for n in allocate._beside(c))
        while len(cells) > size and (edge := [c for c in cells if count(c) < 4]):
            cells.remove(min(edge, key=lambda c: (count(c), c[1], c[0])))
        while len(cells) < size and (free := {x for c in cells for x in allocate._beside(c)} - cells - taken):
            cells.add(min(free, key=lambda c: (-count(c), c[1], c[0])))
        return cells

    for _ in range(150):
        taken = {(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(5, 60))}
        part, size = allocate.pieces(taken)[0], rng.randrange(1, 50)
        assert allocate.resize_cells(part, taken, size) == slowly(part, taken, size)


def test_rejoin_keeps_budgets_and_mends_pieces():
    rng = random.Random(2)
    total = lambda owner: sum(len(allocate.pieces({c for c in owner if owner[c] == r})) for r in set(owner.values()))
    before = after = 0
    for _ in range(60):
        owner = {(c, r): rng.randrange(4) if rng.random() < 0.1 else c // 4 + 2 * (r // 4) for c in range(8) for r in range(8)}
        new = allocate.rejoin(owner)
        assert sorted(new.values()) == sorted(owner.values()) and total(new) <= total(owner)
        before, after = before + total(owner) - 4, after + total(new) - 4
    assert after < 0.4 * before
    whole = {(c, r): c // 2 for c in range(6) for r in range(3)}
    assert allocate.rejoin(whole) == whole
    far = {(c, 0): c // 3 for c in range(9)} | {(8, 1): 0, (0, 1): 2}  # a piece of the first beside the third
    new = allocate.rejoin(far)
    assert total(new) <= total(far) and sorted(new.values()) == sorted(far.values())


def test_maps_in_degrees(spark):
    """Insets have boxes of their own, equal areas stay equal under laea, and what has no finite place goes."""
    box = lambda x, y: ([float(x), x + 1.0, x + 1.0, float(x)], [float(y), float(y), y + 1.0, y + 1.0])
    rings = [("w", "1", 0, *box(0, 40)), ("w", "2", 1, *box(1, 40)), ("w", "3", 2, *box(-16, 28)), ("i", "A1", 0, *box(14, 53)), ("i", "IS", 1, *box(-20, 64)), ("i", "CY", 2, *box(33, 35)), ("w", "4", 3, [0.0, float("nan"), 1.0], [0.0, 1.0, 2.0])]
    ring = spark.createDataFrame([(g, r, f, 0, 0, xs, ys) for g, r, f, xs, ys in rings], "geo string, region_id string, feature_ord int, poly_ord int, ring_ord int, xs array<double>, ys array<double>")
    kinds = spark.createDataFrame([("w", "west", "mercator"), ("i", "islands", "laea")], "geo string, insets string, projection string")
    weights = spark.createDataFrame([("w|1", "w", "1", 1.0), ("w|1", "w", "3", 1.0), ("w|2", "w", "1", 99.0), ("w|2", "w", "3", 1.0), ("i|1", "i", "A1", 1.0)], "map_id string, geo string, region_id string, w double")
    drawn = {(r.geo, r.region_id): (r.inset, r.xs, r.ys) for r in geo.projected_maps(ring, kinds, weights).collect()}
    assert {k: v[0] for k, v in drawn.items()} == {(m, "1"): "main" for m in ("w|1", "w|2")} | {(m, "2"): "main" for m in ("w|1", "w|2")} | {(m, "3"): "canaries" for m in ("w|1", "w|2")} | {("i|1", "A1"): "main", ("i|1", "IS"): "iceland", ("i|1", "CY"): "east"}
    width = lambda m, r: max(drawn[m, r][1]) - min(drawn[m, r][1])
    assert width("w|1", "3") > width("w|2", "3")  # by its share of the weight
    for (_, _), (inset, xs, ys) in drawn.items():
        assert 0 <= min(xs) and max(xs) <= 2000 and (inset == "main" or min(ys) >= 60)


@pytest.mark.parametrize("projection", ["laea", "mercator"])
def test_fit_measures_edges_as_great_arcs(spark, projection):
    """Against a dense walk along the arcs: the drawing fills its box to a hundredth of a pixel."""
    lon, lat = [-12.0, 40.0, 40.0, -12.0], [34.0, 34.0, 66.0, 66.0]
    ring = spark.createDataFrame([("e", "A", 0, 0, 0, lon, lat)], "geo string, region_id string, feature_ord int, poly_ord int, ring_ord int, xs array<double>, ys array<double>")
    kinds = spark.createDataFrame([("e", "none", projection)], "geo string, insets string, projection string")
    weights = spark.createDataFrame([("m", "e", "A", 1.0)], "map_id string, geo string, region_id string, w double")
    r = geo.projected_maps(ring, kinds, weights).first()

    def to(x, y):
        x, y = np.radians(x), np.radians(y)
        if projection == "mercator":
            return x, -np.log(np.tan(np.pi / 4 + y / 2))
        x, y0 = x - np.radians(15), np.radians(54)
        k = np.sqrt(2 / (1 + np.sin(y0) * np.sin(y) + np.cos(y0) * np.cos(y) * np.cos(x)))
        return k * np.cos(y) * np.sin(x), -k * (np.cos(y0) * np.sin(y) - np.sin(y0) * np.cos(y) * np.cos(x))

    p = np.radians(np.array([lon, lat]))
    unit = np.stack([np.cos(p[1]) * np.cos(p[0]), np.cos(p[1]) * np.sin(p[0]), np.sin(p[1])])
    arcs = np.concatenate([unit[:, [i]] + np.linspace(0, 1, 20_001) * (unit[:, [(i + 1) % 4]] - unit[:, [i]]) for i in range(4)], axis=1)
    dense = np.array(to(np.degrees(np.arctan2(arcs[1], arcs[0])), np.degrees(np.arctan2(arcs[2], np.hypot(arcs[0], arcs[1])))))
    plain = np.array(to(np.array(lon), np.array(lat)))
    low, high = dense.min(axis=1), dense.max(axis=1)
    k = min(880 / (high[0] - low[0]), 688 / (high[1] - low[1]))
    middle = np.array([450.0, 406.0]) - k * (low + high) / 2
    want = k * plain + middle[:, None]
    assert np.abs(want - np.array([r.xs, r.ys])).max() < 0.01
    assert plain.max(axis=1)[1] - plain.min(axis=1)[1] < (high - low)[1] - 1e-3  # the vertices alone are a smaller extent


@pytest.mark.parametrize("at_once", [200_000, 30])
def test_regions_of_a_map_are_labelled_in_one_task(spark, monkeypatch, at_once):
    """A group a region is slow where maps have a hundred each; only maps of too many runs are dealt by region."""
    monkeypatch.setattr(grid, "RUNS_AT_ONCE", at_once)
    rng = random.Random(8)
    sizes = {"a": 4, "b": 12}
    rows = [(m, c, r, rng.choice("pqr")) for m, n in sizes.items() for c in range(n) for r in range(n) if rng.random() < 0.8]
    parts = grid.grid_components(spark.createDataFrame(rows, CELL), ["region_id"])
    groups = re.findall(r"FlatMapGroupsInPandas \[([^\]]*)\]", parts._jdf.queryExecution().executedPlan().toString())
    assert re.sub(r"#\d+", "", groups[0]) == "map_id"
    expected = {(m, x, *c): root for m in sizes for x in "pqr" for c, root in pieces({(c, r) for k, c, r, y in rows if (k, y) == (m, x)}).items()}
    assert {(p.map_id, p.region_id, p.col, p.row): (p.component >> 20, p.component & 0xFFFFF) for p in parts.collect()} == expected


def test_assignment_of_many_regions_is_the_cheapest():
    """No ring of regions can hand cells on and be cheaper, also where seeds lie on lines, so that many sums are equal."""
    rng = np.random.default_rng(5)
    xy = np.array([(c, r) for c in range(24) for r in range(24) if (c, r) != (3, 3)], float)
    places = np.array([(2.2 + 4 * c, 2.7 + 4 * r) for c in range(6) for r in range(6)])
    for seeds in (places, places + rng.uniform(-2, 2, places.shape), np.zeros((36, 2))):
        budget = np.bincount(rng.choice(36, len(xy), p=rng.dirichlet(np.full(36, 0.4))), minlength=36)
        owner = allocate.capacitated_assign(xy, seeds, budget)
        assert (np.bincount(owner, minlength=36) == budget).all()
        d = ((xy[:, None] - seeds[None]) ** 2).sum(2)
        d -= d[np.arange(len(xy)), owner][:, None]
        way = np.array([d[owner == a].min(0, initial=np.inf) for a in range(36)])
        for k in range(36):
            way = np.minimum(way, way[:, [k]] + way[[k]])
        assert way.diagonal().min() > -1e-9
    with pytest.raises(ValueError):
        allocate.capacitated_assign(xy, places, budget + 1)


def test_maps_are_dealt_to_tasks_by_their_number(spark):
    """Spark would pack the few bytes of all maps into one task, which takes its time for each."""
    cells = spark.range(100 * 6).select(F.concat(F.lit("m"), F.floor(F.col("id") / 6)).alias("map_id"), (F.col("id") % 6).cast("int").alias("col"), F.lit(0).alias("row"), F.lit(0).cast("long").alias("component"))
    plan = spark.range(200).select(F.concat(F.lit("m"), F.floor(F.col("id") / 2)).alias("map_id"), F.lit(0).cast("long").alias("component"), (F.col("id") % 2).cast("string").alias("region_id"), F.lit(3).alias("budget"), (F.col("id") % 2 * 5.0).alias("x"), F.lit(0.0).alias("y"))
    made = allocate.allocate(cells, plan)
    found = made.groupBy("map_id", "region_id").agg(F.count("*").alias("n"), F.min("col").alias("col")).collect()
    assert len(found) == 200 and {(r.n, r.region_id, r.col) for r in found} == {(3, "0", 0), (3, "1", 3)}
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_points_of_arcs_are_worked_out_once(spark):
    rings = spark.createDataFrame([("g", "r", 0, 0, 0, [0.0, 9.0, 9.0], [0.0, 0.0, 9.0])], "geo string, region_id string, feature_ord int, poly_ord int, ring_ord int, xs array<double>, ys array<double>")
    plan = geo.along_arcs(rings, lambda x, y: map_queries.laea(x, y), F.lit(0.001))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("ATAN2(") == 8  # two for each of three points of an edge, and for those between


@pytest.mark.parametrize("at_once", [1 << 18, 3])
def test_points_are_grouped_where_they_are_joined(spark, at_once):
    """One exchange of points; those of polygons are of their rings and of their squares."""
    rings = spark.createDataFrame([("g", "r", 0, 0, 0, [0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 4.0, 4.0])], "geo string, region_id string, feature_ord int, poly_ord int, ring_ord int, xs array<double>, ys array<double>")
    points = spark.createDataFrame([(i, "g", 0.5 + i % 6, 0.5 + i % 5) for i in range(30)], "id long, geo string, x double, y double")
    found = geo.points_in_polygons(points, rings, ["id"], 9.0, at_once)
    assert len(re.findall(r"Exchange hashpartitioning", found._jdf.queryExecution().executedPlan().toString())) == 3
    assert sorted(r.id for r in found.collect()) == [i for i in range(30) if i % 6 < 4 and i % 5 < 4]


@pytest.mark.parametrize("at_once", [200_000, 150, 0])
def test_fill_and_labels_in_one_pass(spark, maps, monkeypatch, at_once):
    """As the two steps one after the other, however many maps are too large for a task."""
    monkeypatch.setattr(grid, "PLACES_AT_ONCE", at_once)
    cells = table(spark, maps)
    row = lambda r: (r.map_id, r.col, r.row, r.region_id, r.component)
    assert sorted(map(row, grid.filled_components(cells).collect())) == sorted(map(row, grid.grid_components(grid.fill_enclosed(cells)).collect()))
    assert grid.filled_components(cells.limit(0)).count() == 0


def test_maps_are_drawn_once_for_cartogram_and_measures(spark, tmp_path, monkeypatch):
    lines = spark.range(100).select(F.col("id").alias("l_partkey"), (1.0 + F.col("id") * 7 % 50).alias("l_quantity"), F.lit(0.01).alias("l_discount"), F.lit("1997-03-01").cast("timestamp").alias("l_shipdate"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(100).select(F.col("id").alias("p_partkey"), F.lit("Brand#11").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    calls, draw = [], geo.projected_maps
    monkeypatch.setattr(geo, "projected_maps", lambda *a: calls.append(1) or draw(*a))
    got = map_queries.cartogram_insets_measures(spark, str(tmp_path)).collect()
    assert len(calls) == 1 and [(r.map_id, r.cells, r.mean_error) for r in got] == [("b0|1997", 1000, 0.0)]
