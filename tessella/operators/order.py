"""Positions within groups of which one may hold most rows.

A window gives each group to one task. Groups too large for that are found by counting, dealt
out in ranges of their order, and numbered by where their rows lie in a range plus what the
ranges before it hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.tables import written

#: Rows of a group that a window gets at least; groups larger than this and than a 4096th of all rows are dealt in ranges.
AT_ONCE, GROUPS_AT_MOST = 1 << 20, 4096


def large_groups(rows: DataFrame, by: list[str], at_once: int = AT_ONCE) -> DataFrame | None:
    """(by.., _size) of the groups of more than `at_once` rows and a 4096th of all, so there are
    fewer than 4096 of them whatever the data; None if there are none. `by` holds no nulls."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_size"))
    total, most = sizes.agg(F.sum("_size"), F.max("_size")).first()
    bar = max(at_once, (total or 0) // GROUPS_AT_MOST)
    return written(sizes.where(F.col("_size") > bar), "sizes") if (most or 0) > bar else None


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str, size: str | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """Adds `name`, the position from 1 of each row of a group in `order`, and, if asked, `size`,
    the number of its rows. Rows equal in all of `order` are numbered in any order. Groups whose
    `by` holds a null are groups too, but each is one task. An empty table gives no rows. The rows are
    written first, so that counting them reads their keys and does not make them twice."""
    rows = written(rows, "rows")
    whole = W.partitionBy(*by)
    counted = [F.count("*").over(whole).alias(size)] if size else []
    at = F.row_number().over(whole.orderBy(*order)).alias(name)
    large = large_groups(rows, by, at_once)
    if large is None:
        return rows.select("*", at, *counted)
    rest = rows.join(F.broadcast(large.select(*by)), by, "left_anti").select(*rows.columns, at, *counted)
    ranged = ranges(rows.join(F.broadcast(large), by), by, order, at_once)
    return rest.unionByName(ranged.select(*rows.columns, F.col("_at").cast("int").alias(name), *([F.col("_size").alias(size)] if size else [])))


def ranges(rows: DataFrame, by: list[str], order: list[Column], at_once: int = AT_ONCE) -> DataFrame:
    """Adds `_at`, the position in its group, to rows of fewer than 4096 groups.

    The rows are sorted in ranges of some `at_once` and written; a range and group together have
    a first row and a count. There are no more such pairs than ranges and groups, so that what
    lies before each is found from a small table.
    """
    parts = max(1, -(-rows.count() // at_once))
    keys = [*[F.col(c) for c in by], *order]
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_line", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_range", F.shiftright("_line", 33)), "ranges")
    pieces = placed.groupBy("_range", *by).agg(F.min("_line").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_range")) - F.col("_n")
    pieces = written(pieces.select("_range", *by, "_first", before.alias("_before")), "pieces")
    out = placed.join(F.broadcast(pieces), ["_range", *by])
    return out.select(*rows.columns, (F.col("_line") - F.col("_first") + F.col("_before") + 1).alias("_at"))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], at_once: int = AT_ONCE) -> DataFrame:
    """(by.., cuts, low, high): the values at `shares` of each group (linear between values), its least
    and largest. Small groups are an aggregate whose buffer is the group; in large ones only
    the rows on both sides of a share are taken, by their positions. No value is null."""
    rows = written(rows.select(*by, value), "values")
    asked = F.array(*[F.lit(s) for s in shares])
    ends = [F.min(value).alias("low"), F.max(value).alias("high")]
    large = large_groups(rows, by, at_once)
    if large is None:
        return rows.groupBy(*by).agg(F.percentile(value, asked).alias("cuts"), *ends)
    rest = rows.join(F.broadcast(large.select(*by)), by, "left_anti").groupBy(*by).agg(F.percentile(value, asked).alias("cuts"), *ends)
    placed = written(ranges(rows.join(F.broadcast(large), by).select(*by, F.col(value).alias("_v"), "_size"), by, [F.col("_v").asc()], at_once), "placed")
    exact = (F.col("_size") - 1) * F.col("_share")
    spots = large.select(*by, "_size", F.posexplode(asked).alias("_k", "_share"))
    spots = spots.select(*by, "_k", exact.alias("_exact"), F.explode(F.array_distinct(F.array(F.floor(exact), F.ceil(exact)))).alias("_spot"))
    found = placed.join(F.broadcast(spots.withColumn("_at", F.col("_spot") + 1)), [*by, "_at"])
    sides = found.groupBy(*by, "_k").agg(F.min(F.struct("_spot", "_v")).alias("_a"), F.max(F.struct("_spot", "_v")).alias("_b"), F.first("_exact").alias("_exact"))
    a, b, more = F.col("_a._v"), F.col("_b._v"), F.col("_exact") - F.col("_a._spot")
    # as Spark's aggregate: the value itself, or both in proportion
    cut = F.when(F.col("_a._spot") == F.col("_b._spot"), a).when(a == b, a).otherwise((F.col("_b._spot") - F.col("_exact")) * a + more * b)
    cuts = sides.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_k", cut.alias("c")))).alias("_c")).select(*by, F.transform("_c", lambda x: x["c"]).alias("cuts"))
    ends = placed.groupBy(*by).agg(F.min("_v").alias("low"), F.max("_v").alias("high"))
    return rest.unionByName(cuts.join(ends, by).select(*by, "cuts", "low", "high"))
