"""Grids of cells, all maps at once: cell(map_id, col, row, x, y, region_id).

Everything is keyed by map_id, so that scale is the number of maps.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.functions.tables import by_merge, importable, written

from .geo import bounds, nearest_cell, points_in_polygons, tile_side
from .order import AT_ONCE, large_groups, ranges

CELL = ["map_id", "col", "row"]
AROUND = ((1, 0), (-1, 0), (0, 1), (0, -1))
#: Runs of cells that one task labels, and neighbouring blocks that are joined at once where a map has more.
RUNS_AT_ONCE, FAN = 200_000, 16
#: Places of a map's frame that one task fills and labels, maps of a task, and tasks that maps are dealt to at most.
PLACES_AT_ONCE, MAPS_AT_ONCE, TASKS_AT_MOST = 200_000, 64, 4096


def largest_remainder(values: DataFrame, total: int | str, by: list[str], key: str = "region_id", value: str = "w", at_once: int = AT_ONCE) -> DataFrame:
    """`total` dealt out in proportion: whole parts, then one each to the largest fractions,
    ties to the least key. A group too large for one task is summed and ranked in ranges."""
    total = F.lit(total) if isinstance(total, int) else F.col(total)
    target = (F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("int")).cast("int").alias("target")
    order = [(F.col("_exact") - F.col("_floor")).desc(), F.col(key)]
    per = W.partitionBy(*by)
    values = written(values, "values")  # made once, though counted and dealt
    large = large_groups(values, by, at_once)
    rest = values if large is None else values.join(F.broadcast(large.select(*by)), by, "left_anti")
    rest = rest.withColumn("_exact", F.col(value) * total / F.sum(value).over(per))
    rest = rest.withColumn("_floor", F.floor("_exact")).withColumn("_left", total - F.sum("_floor").over(per))
    rest = rest.withColumn("_rank", F.row_number().over(per.orderBy(*order))).select(*values.columns, target)
    if large is None:
        return rest
    some = values.join(F.broadcast(large.select(*by)), by)
    sums = written(some.groupBy(*by).agg(F.sum(value).alias("_sum")), "sums")  # as few as there are large groups
    some = some.join(F.broadcast(sums), by).withColumn("_exact", F.col(value) * total / F.col("_sum"))
    some = ranges(some.withColumn("_floor", F.floor("_exact")), by, order, at_once).withColumnRenamed("_at", "_rank")
    floors = some.groupBy(*by).agg(F.sum("_floor").alias("_floors"))
    some = some.join(F.broadcast(floors), by).withColumn("_left", total - F.col("_floors"))
    return rest.unionByName(some.select(*values.columns, target))


def rasterize(ring: DataFrame, tiles: int, bucket_tiles: int = 4) -> DataFrame:
    """Cells whose centres lie in a region; the grid reaches two tiles beyond the bounds."""
    grid = bounds(ring).join(by_merge(tile_side(ring, tiles)), "geo")
    n = lambda a, b: F.ceil((F.col(b) - F.col(a)) / F.col("side")).cast("int") + 4
    centres = grid.select("geo", "side", "x0", "y0", F.explode(F.sequence(F.lit(0), n("x0", "x1") - 1)).alias("col"), n("y0", "y1").alias("_rows"))
    centres = centres.select("geo", "side", "x0", "y0", "col", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)).alias("row"))
    at = lambda i, o: (F.col(i) + 0.5 - 2) * F.col("side") + F.col(o)
    points = centres.select("geo", "side", "col", "row", at("col", "x0").alias("_x"), at("row", "y0").alias("_y"))
    # buckets in units of the tile, so that points and polygons of all maps are dealt alike
    scaled = ring.join(by_merge(grid.select("geo", "side")), "geo").select(*[c for c in ring.columns if c not in ("xs", "ys")], F.transform("xs", lambda v: v / F.col("side")).alias("xs"), F.transform("ys", lambda v: v / F.col("side")).alias("ys"))
    unit = points.select("geo", "col", "row", "_x", "_y", (F.col("_x") / F.col("side")).alias("x"), (F.col("_y") / F.col("side")).alias("y"))
    found = points_in_polygons(unit, scaled, ["geo", "col", "row", "_x", "_y"], bucket_tiles)
    return found.select(F.col("geo").alias("map_id"), "col", "row", F.col("_x").alias("x"), F.col("_y").alias("y"), "region_id")


def neighbour_pairs(cells: DataFrame) -> DataFrame:
    """(cell, n_col, n_row, n_region) for each of the four neighbours that exist."""
    there = cells.select("map_id", F.col("col").alias("n_col"), F.col("row").alias("n_row"), F.col("region_id").alias("n_region"))
    around = F.array(*[F.struct(F.lit(a).alias("dc"), F.lit(b).alias("dr")) for a, b in AROUND])
    rows = cells.select(*CELL, "region_id", F.explode(around).alias("_o"))
    rows = rows.select(*CELL, "region_id", (F.col("col") + F.col("_o.dc")).alias("n_col"), (F.col("row") + F.col("_o.dr")).alias("n_row"))
    return rows.join(by_merge(there), ["map_id", "n_col", "n_row"])


def exposure(cells: DataFrame) -> DataFrame:
    """How many of a cell's four sides have no cell of its own region."""
    same = neighbour_pairs(cells).where("region_id <=> n_region").groupBy(*CELL).agg(F.count("*").alias("_n"))
    return cells.select(*CELL, "region_id").join(by_merge(same), CELL, "left").select(*CELL, "region_id", (4 - F.coalesce("_n", F.lit(0))).cast("int").alias("exposure"))


def region_adjacency(cells: DataFrame) -> DataFrame:
    return neighbour_pairs(cells).where("region_id <> n_region").select("map_id", "region_id", "n_region").distinct()


def majority_region(cells: DataFrame, empty: DataFrame) -> DataFrame:
    """The most frequent region around each empty cell (map_id, col, row), ties to the least id."""
    around = neighbour_pairs(empty.select(*CELL, F.lit(None).cast("string").alias("region_id")).unionByName(cells.select(*CELL, "region_id")))
    counts = around.where("region_id is null and n_region is not null").groupBy(*CELL, "n_region").agg(F.count("*").alias("_n"))
    first = F.row_number().over(W.partitionBy(*CELL).orderBy(F.col("_n").desc(), "n_region"))
    return counts.withColumn("_k", first).where("_k = 1").select(*CELL, F.col("n_region").alias("region_id"))


def grid_components(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """4-connected components, within the key `by` besides the map; a component is named by
    its least cell, as `component` = col * 2^20 + row of it.

    Cells of a column that follow each other are one run; only runs are labelled, those of a
    map in one task. Where it has more than RUNS_AT_ONCE they are labelled by `by`, and by blocks of
    columns where one key has more.
    """
    by, cells = ["map_id", *(by or [])], cells.drop("component")
    order = W.partitionBy(*by, "col").orderBy("row")
    rows = cells.withColumn("_island", (F.col("row") - F.row_number().over(order)).cast("int"))
    runs = written(rows.groupBy(*by, "col", "_island").agg(F.min("row").cast("int").alias("top"), F.max("row").cast("int").alias("bottom")), "runs")
    importable(cells.sparkSession)
    schema = runs.select(*by, F.col("col").cast("int"), "_island").schema.add("component", "long")
    labels = lambda runs, key: runs.groupBy(*key).applyInPandas(lambda part: _labelled(part, by)[schema.names], schema)
    over = lambda runs, key: runs.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > RUNS_AT_ONCE).select(*key)
    maps = over(runs, ["map_id"])
    named = labels(runs.join(by_merge(maps), "map_id", "left_anti"), ["map_id"])
    if maps.head(1):
        runs = runs.join(by_merge(maps), "map_id", "left_semi")
        large = over(runs, by)
        if len(by) > 1:
            named = named.unionByName(labels(runs.join(by_merge(large), by, "left_anti"), by))
        if large.head(1):
            named = named.unionByName(_block_components(runs.join(by_merge(large), by, "left_semi"), by))
    return rows.join(by_merge(named), [*by, "col", "_island"]).drop("_island")


def _labelled(runs: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """The component of each run of one map, within each key: runs of neighbouring columns that meet are one."""
    # keys lie side by side, with a gap between
    key = runs.groupby(by, sort=False).ngroup().astype("int64") * (int(runs["col"].max()) - int(runs["col"].min()) + 2)
    runs = runs.assign(_at=key + runs["col"]).sort_values(["_at", "top"]).reset_index(drop=True)
    at_col, col, top, bottom = (runs[c].tolist() for c in ("_at", "col", "top", "bottom"))
    root = list(range(len(col)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first = 0  # of the runs in the column before
    for k in range(len(col)):
        while first < k and (at_col[first] < at_col[k] - 1 or (at_col[first] == at_col[k] - 1 and bottom[first] < top[k])):
            first += 1
        at = first
        while at < k and at_col[at] == at_col[k] - 1 and top[at] <= bottom[k]:
            a, b = sorted((find(at), find(k)))
            root[b] = a
            at += 1
    # the least run of a component has its least cell
    return runs.assign(component=[(col[x] << 20) + top[x] for x in map(find, range(len(col)))])


def _block_components(runs: DataFrame, by: list[str]) -> DataFrame:
    """Components of maps too large for a task: columns are dealt to blocks of some RUNS_AT_ONCE runs,
    each labelled in a task; what meets across the border of two blocks is joined, FAN neighbouring
    blocks at a time, then FAN of those, and so on. The number of rounds follows from the number
    of blocks and not from the shape, and only components that reach a border take part."""
    across = W.partitionBy(*by).orderBy("col")
    columns = runs.groupBy(*by, "col").agg(F.count("*").alias("_n"))
    columns = columns.withColumn("_block", F.floor((F.sum("_n").over(across) - F.col("_n")) / RUNS_AT_ONCE))
    border = lambda side, step: F.coalesce((side("col").over(across) == F.col("col") + step) & (side("_block").over(across) != F.col("_block")), F.lit(False))
    columns = columns.select(*by, "col", "_block", border(F.lag, -1).alias("_left"), border(F.lead, 1).alias("_right"))
    placed = runs.join(by_merge(columns), [*by, "col"]).withColumn("col", F.col("col").cast("int"))
    schema = _extended(placed.schema, component="long")
    local = written(placed.groupBy(*by, "_block").applyInPandas(lambda part: _labelled(part, by)[schema.names], schema), "blocks")
    side = lambda flag, at: local.where(flag).select(*by, (F.col("col") + at).alias("_border"), F.lit(at == 0).alias("_ahead"), "top", "bottom", "_block", "component")
    key = runs.select(*by).schema
    meets = _extended(key, u="long", v="long", bu="long", bv="long")
    edges = side("_left", 0).unionByName(side("_right", 1)).groupBy(*by, "_border").applyInPandas(lambda part: _met(part, by), meets)
    edges, moved, width = written(edges, "borders"), None, FAN
    while edges.head(1):
        same = F.floor(F.col("bu") / width) == F.floor(F.col("bv") / width)
        roots = edges.where(same).groupBy(*by, F.floor(F.col("bu") / width)).applyInPandas(lambda part: _united(part, by), _extended(key, node="long", root="long"))
        roots = written(roots, "roots")
        edges = edges.where(~same)
        for end in "uv":
            edges = edges.join(by_merge(roots.withColumnsRenamed({"node": end, "root": "_root"})), [*by, end], "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
        edges = written(edges.select(*meets.names).distinct(), "borders")
        if moved is None:
            moved = roots
        else:
            later = roots.select(*by, F.col("root").alias("_root"), F.col("node").alias("root"))
            moved = written(moved.join(by_merge(later), [*by, "root"], "left").select(*by, "node", F.coalesce("_root", "root").alias("root")).unionByName(roots), "roots")
        width *= FAN
    names = [*by, "col", "_island", "component"]
    if moved is None:
        return local.select(*names)
    # a block's component has no more runs than its block
    named = local.join(by_merge(moved.withColumnRenamed("node", "component")), [*by, "component"], "left")
    return named.withColumn("component", F.coalesce("root", "component")).select(*names)


def _extended(schema: StructType, **columns: str) -> StructType:
    out = StructType(list(schema.fields))
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out


def _met(part: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """The components on both sides of one border that have runs side by side."""
    left, right = (part[part["_ahead"] == ahead].sort_values("top") for ahead in (False, True))
    top, bottom, names = (left[c].tolist() for c in ("top", "bottom", "component"))
    found, first = set(), 0
    for t, b, name in zip(right["top"].tolist(), right["bottom"].tolist(), right["component"].tolist(), strict=True):
        while first < len(top) and bottom[first] < t:
            first += 1
        at = first
        while at < len(top) and top[at] <= b:
            found.add((names[at], name))
            at += 1
    out = pd.DataFrame(sorted(found), columns=["u", "v"], dtype="int64")
    out = out.assign(**{c: part[c].iloc[0] for c in by}, bu=0 if left.empty else left["_block"].iloc[0], bv=0 if right.empty else right["_block"].iloc[0])
    return out[[*by, "u", "v", "bu", "bv"]]


def _united(part: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """The least component that each one is joined to; those that are the least themselves are left out."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in zip(part["u"].tolist(), part["v"].tolist(), strict=True):
        a, b = sorted((find(u), find(v)))
        root[b] = a
    out = pd.DataFrame([(x, find(x)) for x in list(root) if find(x) != x], columns=["node", "root"], dtype="int64")
    return out.assign(**{c: part[c].iloc[0] for c in by})[[*by, "node", "root"]]


def fill_enclosed(cells: DataFrame) -> DataFrame:
    """Cells, with the empty ones that no way leads out of: those are filled row by row, each by
    the majority of what is around it by then, ties to the least id."""
    cells = cells.select(*CELL, "region_id")
    box = cells.groupBy("map_id").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row").alias("r0"), F.max("row").alias("r1"))
    grid = box.select("*", F.explode(F.expr("sequence(c0 - 1, c1 + 1)")).alias("col")).select("*", F.explode(F.expr("sequence(r0 - 1, r1 + 1)")).alias("row"))
    free = grid.join(by_merge(cells), CELL, "left_anti").select(*CELL, ((F.col("col") < F.col("c0")) & (F.col("row") < F.col("r0"))).alias("_out"))
    parts = written(grid_components(free), "free")
    outside = parts.where("_out").select("map_id", "component").distinct()
    holes = parts.join(by_merge(outside), ["map_id", "component"], "left_anti").select("map_id", "component", "col", "row")
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in AROUND]))
    rim = holes.withColumn("_o", around).select("map_id", "component", (F.col("col") + F.col("_o.a")).alias("col"), (F.col("row") + F.col("_o.b")).alias("row")).distinct().join(by_merge(cells), CELL)
    names = ["map_id", "component", "col", "row", "region_id"]
    both = rim.select(*names).unionByName(holes.withColumn("region_id", F.lit(None).cast("string")).select(*names))
    importable(cells.sparkSession)
    filled = both.groupBy("map_id", "component").applyInPandas(_filled, "map_id string, col int, row int, region_id string")
    return cells.unionByName(filled)


def _filled(part: pd.DataFrame) -> pd.DataFrame:
    """The cells of one hole with their regions; the part has the hole's rim too."""
    known = {(c, r): x for c, r, x in zip(part["col"], part["row"], part["region_id"], strict=True) if x is not None}
    hole = part[part["region_id"].isna()].sort_values(["row", "col"])
    out = []
    for c, r in zip(hole["col"].tolist(), hole["row"].tolist(), strict=True):
        around = [known[c + a, r + b] for a, b in AROUND if (c + a, r + b) in known]
        known[c, r] = min(set(around), key=lambda x: (-around.count(x), x))
        out.append(known[c, r])
    return hole.assign(region_id=out)[["map_id", "col", "row", "region_id"]]


def filled_components(cells: DataFrame) -> DataFrame:
    """fill_enclosed, with the grid_components of what it gives: a map whose frame is small in one pass."""
    cells = cells.select(*CELL, "region_id")
    wide = lambda c: F.max(c).cast("long") - F.min(c) + 3
    frames = cells.groupBy("map_id").agg((wide("col") * wide("row")).alias("_places"))
    maps, most = frames.agg(F.count("*"), F.max("_places")).first()
    large = frames.where(F.col("_places") > PLACES_AT_ONCE).select("map_id")
    small = cells if (most or 0) <= PLACES_AT_ONCE else cells.join(by_merge(large), "map_id", "left_anti")
    importable(cells.sparkSession)
    dealt = small.repartition(min(TASKS_AT_MOST, -(-maps // MAPS_AT_ONCE)) or 1, "map_id")
    out = dealt.groupBy("map_id").applyInPandas(_settled, "map_id string, col int, row int, region_id string, component long")
    if small is cells:
        return out
    filled = written(fill_enclosed(cells.join(by_merge(large), "map_id", "left_semi")), "filled")
    return out.unionByName(grid_components(filled).select(out.columns))


def _settled(part: pd.DataFrame) -> pd.DataFrame:
    """The cells of one map, with those of its holes and the component of each."""
    known = dict(zip(zip(part["col"].tolist(), part["row"].tolist(), strict=True), part["region_id"].tolist(), strict=True))
    (c0, c1), (r0, r1) = ((part[x].min() - 1, part[x].max() + 1) for x in ("col", "row"))
    free = {(c, r) for c in range(c0, c1 + 1) for r in range(r0, r1 + 1)} - known.keys()
    _reached((c0, r0), free)
    holes = sorted(free, key=lambda c: (c[1], c[0]))
    for c, r in holes:
        around = [x for x in (known.get((c + a, r + b)) for a, b in AROUND) if x is not None]
        known[c, r] = min(set(around), key=lambda x: (-around.count(x), x), default=None)
    left, name = set(known), {}
    while left:
        found = _reached(next(iter(left)), left)
        name |= dict.fromkeys(found, (lambda c: (c[0] << 20) + c[1])(min(found)))
    more = pd.DataFrame({"map_id": part["map_id"].iloc[0], "col": [c for c, _ in holes], "row": [r for _, r in holes], "region_id": [known[c] for c in holes]})
    out = pd.concat([part, more.astype({"col": part["col"].dtype, "row": part["row"].dtype})]) if holes else part
    return out.assign(component=[name[c] for c in zip(out["col"].tolist(), out["row"].tolist(), strict=True)])


def _reached(start: tuple[int, int], left: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The places of `left` that hang together with one of them; they are taken from it."""
    left.discard(start)
    found = [start]
    for c, r in found:  # grows meanwhile
        for x in ((c + 1, r), (c - 1, r), (c, r + 1), (c, r - 1)):
            if x in left:
                left.remove(x)
                found.append(x)
    return found


def region_placement(cells: DataFrame, targets: DataFrame, seeds: DataFrame) -> DataFrame:
    """Cells of each region in each component (cells has `component`); a region with a target
    but no cell goes to the component of the cell nearest to its seed, with weight 1."""
    here = cells.where("region_id is not null").groupBy("map_id", "component", "region_id").agg(F.count("*").alias("here"))
    lost = targets.where("target > 0").join(by_merge(here), ["map_id", "region_id"], "left_anti").join(by_merge(seeds), ["map_id", "region_id"])
    near = nearest_cell(lost.select("map_id", "region_id", "x", "y"), cells, "map_id", ["region_id"])
    placed = near.join(by_merge(cells.select(*CELL, "component")), CELL).select("map_id", "component", "region_id", F.lit(1).cast("long").alias("here"))
    return here.unionByName(placed)


def component_budget(placement: DataFrame, targets: DataFrame) -> DataFrame:
    """Each component's whole number of tiles, dealt to its regions by largest remainder;
    components with none go."""
    everywhere = placement.groupBy("map_id", "region_id").agg(F.sum("here").alias("_all"))
    rows = placement.join(by_merge(everywhere), ["map_id", "region_id"]).join(by_merge(targets.where("target > 0")), ["map_id", "region_id"])
    rows = rows.withColumn("w", F.col("target") * F.col("here") / F.col("_all"))
    totals = rows.groupBy("map_id", "component").agg(F.floor(F.sum("w") + 0.5).cast("int").alias("total")).where("total > 0")
    dealt = largest_remainder(rows.drop("target").join(by_merge(totals), ["map_id", "component"]), "total", ["map_id", "component"])
    return dealt.select("map_id", "component", "region_id", "total", F.col("target").alias("budget"))


def allocation_error(cells: DataFrame, targets: DataFrame, least: int = 3) -> DataFrame:
    """|got - target| / target in per cent over targets of at least `least`: mean, upper
    median, largest, number."""
    got = cells.groupBy("map_id", "region_id").agg(F.count("*").alias("got"))
    rows = targets.where(F.col("target") >= least).join(by_merge(got), ["map_id", "region_id"], "left")
    error = F.abs(F.coalesce("got", F.lit(0)) - F.col("target")) / F.col("target") * 100
    out = rows.groupBy("map_id").agg(F.avg(error).alias("mean"), F.array_sort(F.collect_list(error)).alias("_e"), F.max(error).alias("max"), F.count("*").alias("n"))
    return out.select("map_id", "mean", F.get("_e", F.floor(F.col("n") / 2).cast("int")).alias("median"), "max", "n")


def worst_allocations(cells: DataFrame, targets: DataFrame, k: int = 4, least: int = 3) -> DataFrame:
    got = cells.groupBy("map_id", "region_id").agg(F.count("*").alias("got"))
    rows = targets.where(F.col("target") >= least).join(by_merge(got), ["map_id", "region_id"], "left").withColumn("got", F.coalesce("got", F.lit(0)))
    rows = rows.withColumn("error", F.floor((F.col("got") - F.col("target")) / F.col("target") * 100 + 0.5).cast("int"))
    pos = F.row_number().over(W.partitionBy("map_id").orderBy(F.abs("error").desc(), "region_id"))
    return rows.withColumn("pos", pos).where(F.col("pos") <= k).select("map_id", "region_id", "target", "got", "error", "pos")


def compactness(cells: DataFrame, side: float = 1.0, least: int = 8) -> DataFrame:
    """Mean distance from a region's centre over that of a disc of its size; the map's mean."""
    centre = cells.groupBy("map_id", "region_id").agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"), F.count("*").alias("n")).where(F.col("n") >= least)
    rows = cells.join(by_merge(centre), ["map_id", "region_id"]).groupBy("map_id", "region_id").agg(F.avg(F.hypot(F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy"))).alias("_r"), F.first("n").alias("n"))
    each = rows.withColumn("_v", F.col("_r") / (2 / 3 * F.sqrt(F.col("n") / F.pi()) * side))
    return each.groupBy("map_id").agg(F.avg("_v").alias("compactness"), F.count("*").alias("regions"))


def drift(cells: DataFrame, centres: DataFrame, diagonal: DataFrame) -> DataFrame:
    """How far regions' cells lie from their true centres (map_id, region_id, x, y), as a share
    of the map's diagonal (map_id, diagonal): mean and 95th percentile."""
    blobs = cells.groupBy("map_id", "region_id").agg(F.avg("x").alias("_bx"), F.avg("y").alias("_by"))
    rows = blobs.join(by_merge(centres), ["map_id", "region_id"]).join(by_merge(diagonal), "map_id")
    d = F.hypot(F.col("_bx") - F.col("x"), F.col("_by") - F.col("y")) / F.col("diagonal")
    out = rows.groupBy("map_id").agg(F.avg(d).alias("mean"), F.array_sort(F.collect_list(d)).alias("_d"), F.count("*").alias("n"))
    return out.select("map_id", "mean", F.get("_d", F.floor(F.col("n") * 0.95).cast("int")).alias("p95"), "n")


def fragmentation(cells: DataFrame) -> DataFrame:
    """Regions of each map, and how many of them are in more than one piece."""
    parts = grid_components(cells, ["region_id"]).groupBy("map_id", "region_id").agg(F.count_distinct("component").alias("_n"))
    return parts.groupBy("map_id").agg(F.count("*").alias("regions"), F.count_if(F.col("_n") > 1).alias("fragmented"))


def open_cell(cells: DataFrame, side: float = 1.0, cap: int = 40) -> DataFrame:
    """The cell of each region with most room for a label: runs of its region to all sides."""

    def run(along: str, across: str, ahead: bool):
        island = W.partitionBy("map_id", "region_id", across, f"_{along}").orderBy(F.col(along).desc() if ahead else F.col(along))
        return F.least(F.row_number().over(island) - 1, F.lit(cap))

    rows = cells.withColumn("_col", F.col("col") - F.row_number().over(W.partitionBy("map_id", "region_id", "row").orderBy("col")))
    rows = rows.withColumn("_row", F.col("row") - F.row_number().over(W.partitionBy("map_id", "region_id", "col").orderBy("row")))
    width = (2 * F.least(run("col", "row", False), run("col", "row", True)) + 1) * side
    height = (2 * F.least(run("row", "col", False), run("row", "col", True)) + 1) * side
    rows = rows.withColumn("width", width).withColumn("height", height)
    room = F.least(F.col("width"), 3.2 * F.col("height"))
    first = F.row_number().over(W.partitionBy("map_id", "region_id").orderBy(room.desc(), "row", "col"))
    return rows.withColumn("_k", first).where("_k = 1").select("map_id", "region_id", "col", "row", "width", "height")
