"""Cells to regions under exact budgets, and the whole cartogram.

The only Python of the reference jobs: one map's cells and regions at a time, in numpy. A
map has a few thousand cells at most, by its tile budget.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.tables import by_merge, importable, written

from . import geo, grid

ROUNDS, PULL = 4, 0.25
#: Steps of prices at most, before what is astray moves one cell at a time.
NEWTON = 40
#: Maps that a task assigns, and tasks that maps are dealt to at most.
MAPS_AT_ONCE, TASKS_AT_MOST = 16, 4096


Cell = tuple[int, int]


def _beside(c: Cell) -> list[Cell]:
    return [(c[0] + a, c[1] + b) for a, b in grid.AROUND]


def resize_cells(cells: set[Cell], taken: set[Cell], size: int) -> set[Cell]:
    """A component of exactly `size` cells, one cell at a time: the cell with fewest neighbours goes,
    or the free place with most comes, ties by (row, col). A cell with four neighbours never goes, so no
    hole is made; `taken` are cells of any component. Counts are kept up to date in a queue, so
    that each step costs the changed cell's neighbours only."""
    cells = set(cells)
    count = lambda c: sum(n in cells for n in _beside(c))
    queue = [(count(c), c[1], c[0]) for c in cells] if len(cells) > size else []
    heapq.heapify(queue)
    while len(cells) > size and queue:
        n, row, col = heapq.heappop(queue)
        if (col, row) in cells and n == count((col, row)) < 4:  # else it has changed since
            cells.remove((col, row))
            for x in _beside((col, row)):
                if x in cells:
                    heapq.heappush(queue, (count(x), x[1], x[0]))
    free = {x for c in cells for x in _beside(c)} - cells - taken if len(cells) < size else set()
    queue = [(-count(c), c[1], c[0]) for c in free]
    heapq.heapify(queue)
    while len(cells) < size and queue:
        n, row, col = heapq.heappop(queue)
        if (col, row) not in cells and -n == count((col, row)):
            cells.add((col, row))
            for x in _beside((col, row)):
                if x not in cells and x not in taken:
                    heapq.heappush(queue, (-count(x), x[1], x[0]))
    return cells


def pieces(cells: set[Cell]) -> list[set[Cell]]:
    """Cells that hang together, the largest first, ties to the one with the least cell."""
    left, out = set(cells), []
    while left:
        part, edge = set(), [left.pop()]
        while edge:
            c = edge.pop()
            part.add(c)
            for x in _beside(c):
                if x in left:
                    left.remove(x)
                    edge.append(x)
        out.append(part)
    return sorted(out, key=lambda p: (-len(p), min(p)))


def rejoin(owner: dict[Cell, int], passes: int = 3) -> dict[Cell, int]:
    """Owners of the cells of one component, with fewer regions in pieces; each keeps its number of cells.

    A fragment's cells go to the regions around them. For each, one cell moves back along a path of
    regions that touch, from the one that got the cell to the fragment's own region, whose main piece
    grows by it; a region on the way gives a cell of its border that it does not need to hang
    together. What is changed stays only if there are fewer pieces than before.
    """
    owner = dict(owner)
    own: dict[int, set[Cell]] = {}
    for c, r in owner.items():
        own.setdefault(r, set()).add(c)

    def gift(own: dict, giver: int, home: set[Cell], banned: set[Cell]) -> Cell | None:
        """A cell of `giver` beside `home` without which it is in no more pieces."""
        now = len(pieces(own[giver]))
        near = sorted(c for c in own[giver] if c not in banned and any(x in home for x in _beside(c)))
        near.sort(key=lambda c: -sum(x in home for x in _beside(c)))
        return next((c for c in near if len(own[giver]) > 1 and len(pieces(own[giver] - {c})) <= now), None)

    def path(owner: dict, own: dict, start: int, end: int, home: set[Cell]) -> list[int]:
        """Regions from `end`, whose piece `home` is to grow, to `start`, each touching the one before."""
        came, edge = {end: end}, [end]
        while edge and start not in came:
            following = []
            for r in edge:
                for n in sorted({owner[x] for c in (home if r == end else own[r]) for x in _beside(c) if x in owner} - set(came)):
                    came[n] = r
                    following.append(n)
            edge = following
        out = [start] if start in came else []
        while out and out[-1] != end:
            out.append(came[out[-1]])
        return out[::-1]

    def without(r: int, part: set[Cell], home: set[Cell]) -> tuple[dict, dict] | None:
        """Owners and cells of all regions after the fragment has gone home, if that can be done."""
        new, mine, home = dict(owner), {k: set(v) for k, v in own.items()}, set(home)

        def move(c: Cell, to: int) -> None:
            mine[new[c]].discard(c)
            mine[to].add(c)
            new[c] = to

        for c in sorted(part):
            around = [new[x] for x in _beside(c) if x in new and new[x] != r]
            host = min(set(around), key=lambda n: (-around.count(n), n)) if around else None
            way = path(new, mine, host, r, home) if around else []
            if len(way) < 2:
                return None
            move(c, host)
            for taker, giver in zip(way, way[1:], strict=False):
                cell = gift(mine, giver, home if taker == r else mine[taker], part)
                if cell is None:
                    return None
                move(cell, taker)
                if taker == r:
                    home.add(cell)
        return new, mine

    total = lambda regions: sum(len(pieces(x)) for x in regions.values())
    for _ in range(passes):
        changed = False
        for r in sorted(own):
            for part in pieces(own[r])[1:]:
                home = pieces(own[r])[0]
                found = without(r, part, home) if part <= own[r] and not part & home else None
                if found and total(found[1]) < total(own):
                    owner, own = found
                    changed = True
        if not changed:
            break
    return owner


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :1] - b[:, 0]) ** 2 + (a[:, 1:] - b[:, 1]) ** 2


def _side_by_side(xy: np.ndarray) -> np.ndarray:
    """Pairs of cells that share a side, as two rows of positions in `xy`."""
    key = xy[:, 0] * 2.0**20 + xy[:, 1]
    order = key.argsort()
    out = []
    for step in (2.0**20, 1.0):
        at = np.minimum(np.searchsorted(key, key + step, sorter=order), len(key) - 1)
        there = key[order[at]] == key + step
        out.append([np.flatnonzero(there), order[at[there]]])
    return np.concatenate(out, axis=1)


def _priced(d: np.ndarray, pairs: np.ndarray, seeds: np.ndarray, budget: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prices, and the owners of cells by least distance less price, that come near the budgets: Newton steps, where
    a price moves each border of its region by the difference over twice the distance of the seeds. A
    step that leaves as many cells astray is taken back and shortened."""
    k = len(budget)
    slope = 0.4 / np.maximum(1.0, np.sqrt(_squared(seeds, seeds)))
    np.fill_diagonal(slope, 0.0)
    share, tries, least, trial = 1.0, 0, np.inf, price
    for _ in range(NEWTON):
        now = (d - trial).argmin(1)
        gap = budget - np.bincount(now, minlength=k)
        astray = np.abs(gap).sum()
        if astray < least:
            price, owner, least, share, tries = trial, now, astray, min(1.0, 2 * share), 0
            if not astray:
                break
            meet = np.bincount(now[pairs[0]] * k + now[pairs[1]], minlength=k * k).reshape(k, k)
            meet = (meet + meet.T) * slope
            held = meet.sum(1)
            step = np.linalg.solve(np.diag(held + np.where(held > 0, 0.02, 0.5)) - meet, gap.astype(float))
        else:
            share, tries = 0.6 * share, tries + 1
            if tries > 4:
                break
        trial = price + share * step
    return price, owner


def assigned(xy: np.ndarray, seeds: np.ndarray, budget: np.ndarray, price: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner of each cell, as in capacitated_assign, and prices to begin with when the seeds have moved a
    little; `pairs` of cells are those that share a side.

    What the prices leave astray moves along shortest paths from over-full to short regions. Costs
    of handing a cell on are taken less prices, and these follow the distances found, so that no cost is negative and a
    search ends at the first short region.
    """
    d = _squared(xy, seeds)
    n, k = d.shape
    price, owner = _priced(d, pairs, seeds, budget, price)
    e = d - price
    e -= e[np.arange(n), owner][:, None]
    small = 1e-12 * max(1.0, float(d.max()))
    gap = budget - np.bincount(owner, minlength=k)
    cost, more, every = np.full((k, k), np.inf), np.zeros(k), np.arange(k)
    order = owner.argsort(kind="stable")
    some, first = np.unique(owner[order], return_index=True)
    cost[some] = np.minimum.reduceat(e[order], first, axis=0)
    while gap.any():
        short, edge = gap > 0, np.flatnonzero(gap < 0)
        dist, came, end = np.full(k, np.inf), np.full(k, -1), np.inf
        dist[edge] = 0.0
        for _ in range(k):
            through = (dist[edge] + more[edge])[:, None] + cost[edge]
            best = through.argmin(0)
            least = through[best, every] - more
            better = np.flatnonzero((least < dist - small) & (least < end))
            dist[better], came[better] = least[better], edge[best[better]]
            end = dist.min(where=short, initial=np.inf)
            edge = better[dist[better] < end]
            if not len(edge):
                break
        if not np.isfinite(end):
            raise ValueError("budgets and cells differ")
        more += np.minimum(dist - end, 0.0)
        path = [int(np.where(short, dist, np.inf).argmin())]
        while came[path[-1]] >= 0:
            path.append(int(came[path[-1]]))
        for b, a in zip(path, path[1:], strict=False):
            mine = np.flatnonzero(owner == a)
            c = mine[e[mine, b].argmin()]
            owner[c] = b
            e[c] -= e[c, b]
        for r in path:
            cost[r] = e[owner == r].min(0, initial=np.inf)
        gap[path[0]] -= 1
        gap[path[-1]] += 1
    return owner, price


def capacitated_assign(xy: np.ndarray, seeds: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """Owner of each cell: every region gets exactly its budget, and the squared distances to
    the seeds are least in sum. Prices first; the rest moves along shortest paths, each of
    which takes one cell from an over-full region to a short one, so that they come to an end.
    The budgets are not negative, and sum to the number of cells."""
    return assigned(xy, seeds, budget, np.zeros(len(seeds)), _side_by_side(xy))[0]


def shrunk(budget: np.ndarray, cells: int) -> np.ndarray:
    """The budgets dealt again over fewer cells, by largest remainder, ties to the first."""
    exact = budget * cells / budget.sum()
    out = np.floor(exact).astype(int)
    out[np.argsort(out - exact, kind="stable")[: cells - out.sum()]] += 1
    return out


def allocate_map(cells: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
    """cells(map_id, col, row, component), plan(component, region_id, budget, x, y) of one map,
    seeds in units of cells -> cells with their region; each region has exactly its budgets."""
    out = []
    taken = set(zip(cells["col"], cells["row"], strict=True))
    for component, part in plan.sort_values(["component", "region_id"]).groupby("component"):
        own = cells[cells["component"] == component]
        part = part[part["budget"] > 0]
        before = set(zip(own["col"], own["row"], strict=True))
        after = resize_cells(before, taken, int(part["budget"].sum()))
        taken = (taken - before) | after
        if not after or part.empty:
            continue
        at = np.array(sorted(after), float)
        anchor = part[["x", "y"]].to_numpy(float)
        budget = part["budget"].to_numpy(int)
        if len(at) != budget.sum():  # no place was left to grow
            budget = shrunk(budget, len(at))
        seeds, price, pairs = anchor, np.zeros(len(part)), _side_by_side(at)
        for _ in range(ROUNDS + 1):
            owner, price = assigned(at, seeds, budget, price, pairs)
            size = np.maximum(1, np.bincount(owner, minlength=len(part)))
            mean = np.stack([np.bincount(owner, at[:, i], len(part)) / size for i in (0, 1)], axis=1)
            seeds = np.where((np.bincount(owner, minlength=len(part)) > 0)[:, None], mean + PULL * (anchor - mean), anchor)
        places = [(int(c), int(r)) for c, r in at]
        whole = rejoin(dict(zip(places, owner.tolist(), strict=True)))
        owner = np.array([whole[p] for p in places], int)
        out.append(pd.DataFrame({"col": at[:, 0].astype(int), "row": at[:, 1].astype(int), "component": component, "region_id": part["region_id"].to_numpy()[owner]}))
    made = pd.concat(out) if out else pd.DataFrame({"col": [], "row": [], "component": [], "region_id": []})
    made.insert(0, "map_id", plan["map_id"].iloc[0] if len(plan) else None)
    return made


def allocate(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """All maps: cells(map_id, col, row, component), plan(map_id, component, region_id, budget, x, y). Maps
    are dealt by their number: Spark would pack them by bytes, of which they have few for the time they take."""
    schema = "map_id string, col int, row int, component long, region_id string"
    importable(cells.sparkSession)
    tasks = min(TASKS_AT_MOST, -(-plan.select("map_id").distinct().count() // MAPS_AT_ONCE)) or 1
    dealt = [rows.repartition(tasks, "map_id").groupBy("map_id") for rows in (cells, plan)]
    return dealt[0].cogroup(dealt[1]).applyInPandas(allocate_map, schema)


def centres(ring: DataFrame, tiles: int) -> DataFrame:
    """(geo, region_id, x, y, diagonal): where each region's seed lies, and the map's diagonal, in units of
    cells of the raster."""
    box = geo.tile_side(ring, tiles).join(by_merge(geo.bounds(ring)), "geo")
    unit = lambda v, o: (F.col(v) - F.col(o)) / F.col("side") + 1.5
    diagonal = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / F.col("side")
    return geo.region_seed(ring).join(by_merge(box), "geo").select("geo", "region_id", unit("x", "x0").alias("x"), unit("y", "y0").alias("y"), diagonal.alias("diagonal"))


def cartogram(weights: DataFrame, ring: DataFrame, tiles: int, geography: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """weights(map_id, geo, region_id, w), ring -> cells and targets of every map: apportion, rasterise,
    fill, label, place, budget, assign, rejoin.

    Rings are in projected coordinates, one drawing for all maps of a geography; or, with
    `geography` (see projected_maps), in degrees: then each map has its own drawing, with its insets.
    """
    weights = written(weights, "weights")  # made once, though used at each step
    if geography is not None:
        ring = written(geo.projected_maps(ring, geography, weights), "drawn")
        weights = weights.withColumn("geo", F.col("map_id"))
    targets = written(grid.largest_remainder(weights.where("w > 0"), tiles, ["map_id"]).select("map_id", "region_id", "target"), "targets")
    base = written(grid.rasterize(ring, tiles), "raster")
    base = grid.filled_components(base).withColumnRenamed("map_id", "geo")
    maps = weights.select("map_id", "geo").distinct()
    cells = base.join(by_merge(maps), "geo").select("map_id", "col", "row", "region_id", "component", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    cells = written(cells, "cells")
    seeds = written(centres(ring, tiles).join(by_merge(maps), "geo").select("map_id", "region_id", "x", "y"), "seeds")
    plan = grid.component_budget(grid.region_placement(cells, targets, seeds), targets).join(by_merge(seeds), ["map_id", "region_id"])
    plan = written(plan, "plan")
    out = allocate(cells.select("map_id", "col", "row", "component"), plan.select("map_id", "component", "region_id", "budget", "x", "y"))
    return written(out, "cartogram"), targets
