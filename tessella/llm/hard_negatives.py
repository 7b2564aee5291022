"""Hard negatives by partial inner products in a rotated basis.

Vectors are rotated so that their leading components hold most of their length (the principal
axes of a bounded sample; any rotation gives the same results). The product of the leading components,
and the product of the lengths of what remains, bound the integer score from both sides, with a slack for
rounding. Pairs whose bounds show that they cannot be among those wanted are discarded, with more
components at each stage; what is left is verified with integer products.

The stated anchors, in blocks, meet the rows, in blocks: a task holds one block of anchors and reads
blocks of rows as they come. Positives only need the blocks whose labels fall into the same bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import importable, lean, table, written

SCALE = 256
#: Anchors and rows in a block; rows whose bounds are computed at once; blocks of rows in a task.
ANCHORS, ROWS, AT_ONCE, BLOCKS_A_TASK = 8192, 2048, 512, 32
LABELS = 64  # buckets of labels
SAMPLE = 1 << 22  # components from which the rotation is learned, at most
MOST_LEADING = 256
STAGES = (4, 2, 1)  # leading components are used up to these parts of them
LARGE = 1 << 20  # vectors with such components go by integers of any size
LIMIT = 1 << 62


def rotation(sample: np.ndarray, width: int) -> np.ndarray:
    """The leading principal axes of the sample, as orthonormal columns."""
    if not len(sample):
        sample = np.zeros((1, width))
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    return np.linalg.qr(axes[:, : max(1, min(MOST_LEADING, width // 2))])[0]


class Block:
    """Vectors of integers, with their leading components and the lengths of what remains at each stage."""

    def __init__(self, row: dict, axes: np.ndarray):
        width = axes.shape[0]
        self.rows, self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids", "labels"))
        self.x = np.frombuffer(row["x"], np.dtype(row["kind"])).reshape(-1, width)
        self.large = row["kind"] == "<f8"
        self.most = int(np.abs(self.x.astype(np.int64)).max(initial=0)) if not self.large else 0
        if self.large:
            return
        x = self.x.astype(float)
        self.exact = x
        lead = x @ axes
        square = (x * x).sum(1)
        self.norm = np.sqrt(square)
        self.lead = lead.astype(np.float32)
        self.stages = sorted({max(1, axes.shape[1] // part) for part in STAGES})
        rest = [np.maximum(square - (lead[:, :m] ** 2).sum(1), 0) + width * 1e-15 * square for m in self.stages]
        self.rest = [np.sqrt(r) * (1 + 1e-6) for r in rest]

    def sides(self, stage: int, slack: float) -> np.ndarray:
        """Columns whose products bound what the leading components leave: lengths of the rest, and of rounding."""
        return np.stack([self.rest[stage], math.sqrt(slack) * self.norm], 1).astype(np.float32) * np.float32(1 + 1e-6)


def products(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer scores of the pairs (i of a, j of b)."""
    if a.large or b.large or a.most * b.most * a.x.shape[1] >= 1 << 53:
        to_ints = lambda x: [[int(v) for v in r] for r in x.tolist()]
        left, right = to_ints(a.x), to_ints(b.x)
        score = [sum(x * y for x, y in zip(left[p], right[q], strict=True)) for p, q in zip(i.tolist(), j.tolist(), strict=True)]
        return np.array([max(-LIMIT, min(LIMIT, s)) for s in score], np.int64)
    if len(i) * 8 > len(a.ids) * len(b.ids):
        return (a.exact @ b.exact.T)[i, j].astype(np.int64)  # integers below 2^53 are exact
    step = 1 << 16
    x, y = a.x.astype(np.int64), b.x.astype(np.int64)
    return np.concatenate([np.einsum("ij,ij->i", x[i[k : k + step]], y[j[k : k + step]]) for k in range(0, len(i), step)] or [np.zeros(0, np.int64)])


class Search:
    """The best rows of a block of anchors: for each anchor and each of its intervals of scores, the
    `k` highest in it; equal scores go by the smaller id."""

    def __init__(self, anchors: Block, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.a, self.low, self.high, self.k, self.same = anchors, low, high, k, same
        shape = (*low.shape, k)
        self.score, self.id = np.full(shape, -LIMIT - 1, np.int64), np.full(shape, np.iinfo(np.int64).max)

    def wanted(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that no bound rules out."""
        a = self.a
        ok = (a.labels[:, None] == b.labels[None, :]) == self.same
        if self.same:
            ok &= a.rows[:, None] != b.rows[None, :]
        if a.large or b.large:
            return np.nonzero(ok)
        bar = np.maximum(self.low, self.score[:, :, -1]).min(1).astype(float)
        top = self.high.max(1).astype(float)
        i = j = partial = None
        for stage, m in enumerate(a.stages):
            slack = (m + 16) * 2.0**-23
            sa, sb = a.sides(stage, slack), b.sides(stage, slack)
            if i is None:
                partial = a.lead[:, :m] @ b.lead[:, :m].T
                span = sa @ sb.T
                ok &= (partial + span >= bar[:, None] * (1 - 1e-6 * np.sign(bar[:, None]))) & (partial - span <= top[:, None] * (1 + 1e-6 * np.sign(top[:, None])))
                i, j = np.nonzero(ok)
                partial = partial[i, j]
            else:
                if len(i) * 8 > ok.size:
                    break  # so many are left that one product of matrices is cheaper
                done = a.stages[stage - 1]
                for s in range(0, len(i), 1 << 16):
                    at = slice(s, s + (1 << 16))
                    partial[at] += np.einsum("ij,ij->i", a.lead[i[at], done:m], b.lead[j[at], done:m])
                span = (sa[i] * sb[j]).sum(1)
                keep = (partial + span >= bar[i] * (1 - 1e-6 * np.sign(bar[i]))) & (partial - span <= top[i] * (1 + 1e-6 * np.sign(top[i])))
                i, j, partial = i[keep], j[keep], partial[keep]
        return i, j

    def add(self, b: Block) -> None:
        i, j = self.wanted(b)
        if not len(i):
            return
        score, ids = products(self.a, b, i, j), b.ids[j]
        if (score >= LIMIT).any():
            raise OverflowError("a score is no integer of 62 bits")
        for n in range(self.low.shape[1]):
            last, last_id = self.score[i, n, -1], self.id[i, n, -1]
            keep = (score >= self.low[i, n]) & (score <= self.high[i, n]) & ((score > last) | (score == last) & (ids < last_id))
            if not keep.any():
                continue
            touched, at = np.unique(i[keep], return_inverse=True)
            at = np.concatenate([at, np.repeat(np.arange(len(touched)), self.k)])
            all_scores = np.concatenate([score[keep], self.score[touched, n].ravel()])
            all_ids = np.concatenate([ids[keep], self.id[touched, n].ravel()])
            order = np.lexsort((all_ids, -all_scores, at))
            starts = np.searchsorted(at[order], np.arange(len(touched)))
            first = order[starts[:, None] + np.arange(self.k)]
            self.score[touched, n], self.id[touched, n] = all_scores[first], all_ids[first]

    def found(self) -> pa.RecordBatch:
        i, n, k = np.nonzero(self.score >= -LIMIT)
        return pa.RecordBatch.from_arrays([pa.array(self.a.rows[i]), pa.array((n + 1).astype(np.int32)), pa.array(self.id[i, n, k]), pa.array(self.score[i, n, k])], ["row", "interval", "id", "score"])


def intervals(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """ceil(low * s / 100) and floor(high * s / 100) of each score, without products beyond 64 bits."""
    q, r = scores // 100, scores % 100
    return low * q - (-low * r) // 100, high * q + high * r // 100


def _blocks(rows: DataFrame, block: Column, width: int, scores: int = 0) -> DataFrame:
    """One row a block: its row numbers, ids, labels, integer components and `scores` numbers a row, as bytes."""

    def pack(found):  # without hints: else all need them
        x = np.zeros((found.num_rows, width))
        v = found.column("v").combine_chunks()
        sizes = np.diff(v.offsets.to_numpy())
        row = np.repeat(np.arange(found.num_rows), sizes)
        x[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = v.flatten().to_numpy()
        most = np.abs(x).max(initial=0)
        kind = "<f8" if most >= LARGE else "|i1" if most < 128 else "<i2" if most < 1 << 15 else "<i4"
        ids = [found.column(c).to_numpy().astype(np.int64).tobytes() for c in ("row", "id", "label")]
        more = np.array(found.column("scores").to_pylist(), np.int64).tobytes() if scores else b""
        block = found.column("block")[0].as_py()
        return pa.table({"block": pa.array([block], pa.int64()), "rows": [ids[0]], "ids": [ids[1]], "labels": [ids[2]], "x": [x.astype(kind).tobytes()], "kind": [kind], "scores": [more]})

    kept = rows.select(block.cast("long").alias("block"), "row", "id", "label", "v", *["scores"] * bool(scores))
    return kept.groupBy("block").applyInArrow(pack, "block long, rows binary, ids binary, labels binary, x binary, kind string, scores binary")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x), x as double; scores are integer inner products. An anchor's
    positives are the best `positives` other rows of its label (all, if fewer); for each, the best
    `negatives` rows of other labels whose score lies within [low, high] percent of the positive's are
    returned (all, if fewer). Equal scores go by the smaller id. Rows with a null id, label or vector, or
    a null or non-finite component, take no part; labels are integers. Rows that share an id are rows
    of their own. Shorter vectors count as ending in zeros. Vectors with components of LARGE or more go by Python's integers, slowly; a
    score of 2^62 or more is an error. An empty table, or one of one label, gives no rows. `is_anchor` is a
    condition on the id column; other columns are not read.
    """
    spark = vectors.sparkSession
    importable(spark)
    real = F.transform(vector_col, lambda x: x.cast("double") * scale)
    ok = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(F.coalesce(ok, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), is_anchor.alias("anchor"), F.col(label_col).cast("long").alias("label"), real.alias("v"), F.monotonically_increasing_id().alias("row"))
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)  # noqa: E731, larger doubles are integers
    rows = rows.withColumn("v", F.transform("v", whole)).withColumn("large", F.exists("v", lambda x: F.abs(x) >= LARGE))
    rows = written(rows.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(LABELS)).cast("int")), "vectors")
    sizes = {r.bucket: r for r in rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("v")).alias("width")).collect()}
    width = max([1, *[r.width for r in sizes.values()]])
    total = sum(r.n for r in sizes.values())
    every = max(1, total * width // SAMPLE)
    drawn = rows.where(~F.col("large") & (F.pmod(F.xxhash64("row"), F.lit(every)) == 0)).select("v").limit(SAMPLE // width + 1).collect()
    sample = np.zeros((len(drawn), width))
    for k, r in enumerate(drawn):
        sample[k, : len(r.v)] = r.v
    axes = spark.sparkContext.broadcast(rotation(sample, width))

    # blocks are numbered through the buckets; those of large components come after
    first, n_rows, n_anchors, at, to = {}, {}, {}, 0, 0
    for b in sorted(sizes):
        n_rows[b], n_anchors[b] = -(-sizes[b].n // ROWS), -(-sizes[b].anchors // ANCHORS)
        first[b], at, to = (at, to), at + n_rows[b], to + n_anchors[b]
    number = lambda of: F.element_at(F.create_map(*[F.lit(x) for b, n in of.items() for x in (b, n)]) if of else F.create_map(F.lit(0), F.lit(0)), F.col("bucket"))
    spread = F.xxhash64("row")
    block = number({b: x for b, (x, _) in first.items()}) + F.pmod(spread, F.greatest(number(n_rows), F.lit(1))) + F.when(F.col("large"), at).otherwise(0)
    anchor_block = number({b: x for b, (_, x) in first.items()}) + F.pmod(spread, F.greatest(number(n_anchors), F.lit(1))) + F.when(F.col("large"), to).otherwise(0)
    bucket_of = lambda column, of, n: F.element_at(F.array(*[F.lit(b) for b in sorted(sizes) for _ in range(of[b])] or [F.lit(0)]), (column % max(1, n) + 1).cast("int"))
    blocks = written(_blocks(rows, block, width).withColumn("bucket", bucket_of(F.col("block"), n_rows, at)), "blocks")
    groups = max(1, -(-at // BLOCKS_A_TASK), min(at, 2 * spark.sparkContext.defaultParallelism))
    group = F.pmod("block", F.lit(groups))

    def meet(anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(row, interval, id, score): the best k of each interval of each anchor, in any group of blocks."""
        mine = lambda b: F.expr("sequence({0}L, {0}L + {1} - 1)".format(*b))
        if same:
            reach = {b: (x, n_anchors[b]) for b, (_, x) in first.items() if n_anchors[b]}
            cases = [F.when(F.col("bucket") == b, F.concat(mine(r), mine((r[0] + to, r[1])))) for b, r in reach.items()]
            partners = F.explode(F.coalesce(*cases, F.array().cast("array<bigint>")))
        else:
            partners = F.explode(mine((0, max(1, 2 * to))))
        here = anchors.select("block").distinct().withColumnRenamed("block", "with")  # few: a number a block of anchors
        rest = blocks.select(partners.alias("with"), group.alias("group"), F.lit(1).alias("side"), *packed)
        rest = rest.join(F.broadcast(here), "with", "left_semi") if to < 1 << 20 else rest.join(here, "with", "left_semi")
        held = anchors.select(F.col("block").alias("with"), F.explode(F.expr(f"sequence(0L, {groups - 1}L)")).alias("group"), F.lit(0).alias("side"), *packed)
        both = held.unionByName(rest).repartition(max(1, min(4096, to * groups)), "with", "group").sortWithinPartitions("with", "group", "side")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = None
            for batch in batches:
                for n in range(batch.num_rows):
                    row = batch.slice(n, 1).to_pylist()[0]
                    if not row["side"]:
                        if search:
                            yield search.found()
                        a = Block(row, axes.value)
                        if same:
                            bounds = np.full((len(a.ids), 1), -LIMIT), np.full((len(a.ids), 1), LIMIT)
                        else:
                            bounds = intervals(np.frombuffer(row["scores"], np.int64).reshape(len(a.ids), -1), low, high)
                        search = Search(a, *bounds, k, same)
                        continue
                    size = 8 * AT_ONCE
                    for s in range(0, len(row["ids"]), size):
                        part = {c: row[c][s : s + size] for c in ("rows", "ids", "labels")}
                        wide = np.dtype(row["kind"]).itemsize * width
                        search.add(Block({**part, "x": row["x"][s // 8 * wide : (s // 8 + AT_ONCE) * wide], "kind": row["kind"]}, axes.value))
            if search:
                yield search.found()

        return both.mapInArrow(lean(run), "row long, interval int, id long, score long")

    packed = ["rows", "ids", "labels", "x", "kind", "scores"]

    def best(found: DataFrame, k: int) -> DataFrame:
        rank = F.expr("row_number() over (partition by row, interval order by score desc, id)")
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    asked = rows.where("anchor")
    near = written(best(meet(written(_blocks(asked, anchor_block, width), "anchors"), positives, True), positives), "positives")
    # an anchor with fewer has scores whose interval is empty
    own = near.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("_s"))
    scores = F.array(*[F.coalesce(F.try_element_at("_s", F.lit(k + 1)), F.lit(-LIMIT)) for k in range(positives)])
    asked = asked.join(own, "row").withColumn("scores", scores).drop("_s")
    far = best(meet(written(_blocks(asked, anchor_block, width, positives), "anchors"), negatives, False), negatives)
    pairs = near.select("row", F.col("rank").alias("interval"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    anchors = rows.where("anchor").select("row", F.col("id").alias("anchor_id"))
    out = far.select("row", "interval", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["row", "interval"]).join(anchors, "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS rid, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(CAST(x AS DOUBLE) * 256) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, c.vec_id AS vec_id, c.rid AS rid, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.rid <> a.rid
), p AS (
  SELECT arid, anchor_id, rid, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.arid, p.rid ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
         s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.arid = p.arid AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
