"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of five-word shingles; texts with the same set are one node. Nodes that agree
in a band of MinHash values are candidates. Their values are compared a few at a time; a pair
is dropped when, given the matches so far and a uniform prior, the probability that its
similarity reaches the threshold falls below TOLERANCE. What is left is verified on the sets.

A group of n alike texts has n^2 links, but no row is made for a pair: candidates are
compared in blocks of a bucket, and verified in blocks of nodes with a common neighbour, of
which just counts and one edge a node come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.graph import connected_components

from .common import HashFilter, importable, join_counted, lean, table, text_or_empty, written

SHINGLE, THRESHOLD = 5, 0.8
#: 32 bands of 4 values: a pair of similarity 0.8 shares no band with probability 5e-8.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEPS, TOLERANCE = (16, 32, 64, 128), 1e-7
BUCKET_BLOCK, NODE_BLOCK, PAIRS_AT_ONCE = 512, 128, 1 << 15
BLOCK, CACHED_WORDS = 1_000_000, 100_000
U = np.uint64


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest of n matches with which P(similarity >= threshold) is at least `tolerance`."""
    for m in range(n + 1):
        # upper tail of Beta(m + 1, n - m + 1) at the threshold
        tail = sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
        if tail >= tolerance:
            return m
    return n


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Sets of shingle hashes; word hashes are kept for words met lately."""

    def __init__(self):
        self.cache: dict[str, int] = {}
        self.old: dict[str, int] = {}
        seeds = _mix(np.arange(1, 2 * HASHES + 1, dtype=U) * U(0x9E3779B97F4A7C15))
        self.a, self.b = seeds[:HASHES] | U(1), seeds[HASHES:]

    def words(self, text: str) -> list[int]:
        words = text.lower().split()
        found = list(map(self.cache.get, words))
        if None in found:
            new = {}
            for w, x in zip(words, found, strict=True):
                if x is None and w not in new:
                    h = self.old.get(w)
                    new[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) if h is None else h
            found = [new[w] if x is None else x for w, x in zip(words, found, strict=True)]
            if len(self.cache) + len(new) > CACHED_WORDS:
                self.old, self.cache = self.cache, {}
            self.cache.update((w, h) for w, h in new.items() if len(w) <= 100)
        return found

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' sorted distinct shingles, and where each text's begin (and the end)."""
        out, starts = [], [0]
        for text in texts:
            w = np.array(self.words(text), U)
            if len(w) < SHINGLE:
                w = np.concatenate([w, np.full(SHINGLE - len(w), len(w), U)]) if len(w) else w
            n = max(0, len(w) - SHINGLE + 1)
            x = np.zeros(n, U)
            for k in range(SHINGLE if n else 0):
                x = _mix(x * U(0x9E3779B97F4A7C15) + w[k : k + n])
            x = np.unique(x)
            out.append(x)
            starts.append(starts[-1] + len(x))
        return np.concatenate(out) if out else np.zeros(0, U), np.array(starts)

    @staticmethod
    def nodes(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A fingerprint of each set."""
        sizes = np.diff(starts)
        out = np.zeros(len(sizes), U)
        some = sizes > 0
        if some.any():
            at = starts[:-1][some]
            out[some] = _mix(np.add.reduceat(_mix(shingles ^ U(0x5851F42D4C957F2D)), at) + sizes[some].astype(U))
        return out.view(np.int64)

    def signatures(self, shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """HASHES MinHash values of 16 bits for each set that is not empty."""
        some = np.diff(starts) > 0
        out = np.zeros((len(some), HASHES), np.uint16)
        if some.any():
            at = starts[:-1][some]
            for k in range(HASHES):
                least = np.minimum.reduceat(shingles * self.a[k] + self.b[k], at)
                out[some, k] = (_mix(least) >> U(48)).astype(np.uint16)
        return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            texts, held, start = [], 0, at
            while at < batch.num_rows and (held < BLOCK or not texts):
                texts.append(batch.column(1)[at].as_py())
                held += len(texts[-1])
                at += 1
            shingles, starts = shingler.sets(texts)
            sigs = shingler.signatures(shingles, starts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(start, at - start) for c in (0, 2)), pa.array(shingler.nodes(shingles, starts)), pa.array(np.diff(starts)), pa.array([s.tobytes() for s in sigs], pa.binary())],
                ["_id", "text_hash", "node", "n", "sig"],
            )


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (band, key, a, b) -> surviving pairs by (place, place)."""
    needed = [least_matches(n) for n in STEPS]
    rest = None

    def survivors(i: np.ndarray, j: np.ndarray, sig: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done = 0
        for upto, least in zip(STEPS, needed, strict=True):
            if done == 0:
                matches = np.zeros(len(i), np.int64)
            matches = matches + (sig[i, done:upto] == sig[j, done:upto]).sum(1)
            keep = matches >= least
            i, j, matches, done = i[keep], j[keep], matches[keep], upto
        # only in the first band in which the two agree
        bands = sig.view(U)
        first = (bands[i] == bands[j]).argmax(1)
        keep = first == band[i]
        return i[keep], j[keep]

    def out(i: np.ndarray, j: np.ndarray, node: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        swap = (place[i, 0] > place[j, 0]) | ((place[i, 0] == place[j, 0]) & (place[i, 1] > place[j, 1]))
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        key = np.stack([place[i, 0], place[i, 1], place[j, 0], place[j, 1]])
        order = np.lexsort(key)
        key, i, j = key[:, order], i[order], j[order]
        starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])) if len(i) else np.zeros(0, np.int64)
        offsets = pa.array(np.concatenate([starts, [len(i)]]).astype(np.int32))
        columns = [pa.array(key[k, starts]) for k in range(4)] + [pa.ListArray.from_arrays(offsets, pa.array(node[x])) for x in (i, j)]
        return pa.RecordBatch.from_arrays(columns, ["l1", "s1", "l2", "s2", "i", "j"])

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        n = t.num_rows
        if not n:
            return
        get = lambda c: t.column(c).to_numpy()
        band, a, b, sub, node = (get(c) for c in ("band", "a", "b", "sub", "node"))
        place = np.stack([get("label"), get("place")], axis=1)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(n, HASHES)
        starts = _group_starts(t)
        left, right, held = [], [], 0
        for s, e in zip(starts, [*starts[1:], n], strict=True):
            if a[s] == b[s]:
                i, j = np.triu_indices(e - s, 1)
            else:
                side = sub[s:e] == a[s]
                i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(side), np.flatnonzero(~side), indexing="ij"))
            # so many at a time that their signatures take little memory
            for at in range(0, len(i), PAIRS_AT_ONCE):
                left.append(i[at : at + PAIRS_AT_ONCE] + s)
                right.append(j[at : at + PAIRS_AT_ONCE] + s)
                held += len(left[-1])
                if held >= PAIRS_AT_ONCE:
                    yield out(*survivors(np.concatenate(left), np.concatenate(right), sig, band), node, place)
                    left, right, held = [], [], 0
        if held:
            yield out(*survivors(np.concatenate(left), np.concatenate(right), sig, band), node, place)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        starts = _group_starts(t)
        cut = starts[-1] if len(starts) else 0  # the last group may go on in the next batch
        yield from work(t.slice(0, cut).combine_chunks())
        rest = t.slice(cut).combine_chunks()
    if rest is not None:
        yield from work(rest)


def _group_starts(t: pa.Table) -> list[int]:
    if not t.num_rows:
        return []
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in ("band", "key", "a", "b"):
        x = t.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new).tolist()


def _pack_sets(found):  # without hints: else all need them
    """One row for the nodes of a place: their sets, from one text each."""
    shingler = Shingler()
    shingles, starts = shingler.sets(found.column("_text").to_pylist())
    node = shingler.nodes(shingles, starts)
    want = found.column("node").to_numpy()
    # a text with another's hash is not the node's
    _, first = np.unique(np.where(node == want, want, -1), return_index=True)
    use = np.sort(first[node[first] == want[first]])
    parts = [shingles[starts[k] : starts[k + 1]] for k in use.tolist()]
    sizes = np.array([len(x) for x in parts], np.int64)
    return pa.table(
        {
            "label": pa.array([found.column("label")[0].as_py()], pa.int64()),
            "place": pa.array([found.column("place")[0].as_py()], pa.int64()),
            "nodes": pa.array([node[use].tobytes()], pa.binary()),
            "copies": pa.array([found.column("copies").to_numpy()[use].astype(np.int64).tobytes()], pa.binary()),
            "sizes": pa.array([sizes.tobytes()], pa.binary()),
            "sets": pa.array([b"".join(x.tobytes() for x in parts)], pa.binary()),
        }
    )


def verify_pairs(i: np.ndarray, j: np.ndarray, shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether the sets i[k] and j[k] have at least the threshold in common."""
    sizes = np.diff(starts)
    used = np.unique(np.concatenate([i, j]))
    if len(i) > 64:
        # the sets as rows of a matrix, of the shingles that more than one has
        row = np.repeat(np.arange(len(used)), sizes[used])
        flat = np.concatenate([shingles[starts[k] : starts[k + 1]] for k in used.tolist()])
        kinds, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        column = np.cumsum(counts > 1) - 1
        keep = counts[inverse] > 1
        row, column = row[keep], column[inverse[keep]]
        shared = np.zeros((len(used), len(used)), np.float32)
        width = int((counts > 1).sum())
        step = max(1024, (1 << 22) // max(1, len(used)))
        for at in range(0, width, step):
            here = (column >= at) & (column < at + step)
            m = np.zeros((len(used), min(step, width - at)), np.float32)
            m[row[here], column[here] - at] = 1
            shared += m @ m.T
        place = np.zeros(len(sizes), np.int64)
        place[used] = np.arange(len(used))
        common = np.rint(shared[place[i], place[j]]).astype(np.int64)
    else:
        common = np.array(
            [len(np.intersect1d(shingles[starts[x] : starts[x + 1]], shingles[starts[y] : starts[y + 1]], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64
        )
    # common / union >= 0.8 in integers
    return 10 * common >= int(10 * THRESHOLD) * (sizes[i] + sizes[j] - common)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(n)[k] for n in batch.schema.names}
            raw = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)  # noqa: B023, E731
            sides = [1, 2] if row["same"].as_py() is False else [1]
            node = np.concatenate([raw(f"nodes{x}", np.int64) for x in sides])
            copies = np.concatenate([raw(f"copies{x}", np.int64) for x in sides])
            starts = np.concatenate([[0], np.cumsum(np.concatenate([raw(f"sizes{x}", np.int64) for x in sides]))])
            shingles = np.concatenate([raw(f"sets{x}", U) for x in sides])
            order = np.argsort(node)
            i, j = (row[c].values.to_numpy() for c in ("i", "j"))
            i, j = (np.minimum(np.searchsorted(node[order], x), len(node) - 1) for x in (i, j))
            i, j = order[i], order[j]
            good = (node[i] == row["i"].values.to_numpy()) & (node[j] == row["j"].values.to_numpy())
            i, j = i[good], j[good]
            if not len(i):
                continue
            good = verify_pairs(i, j, shingles, starts)
            i, j = i[good], j[good]
            links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
            root = np.arange(len(node))
            while True:  # the least node that each is tied to within the block
                new = root.copy()
                np.minimum.at(new, i, root[j])
                np.minimum.at(new, j, root[i])
                new = new[new]
                if (new == root).all():
                    break
                root = new
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(np.rint(links[at]).astype(np.int64)), pa.array(node[root[at]])], ["node", "links", "root"])


def _id_key(id_: Column) -> Column:
    """An id as a key of joins, null too."""
    return F.coalesce(id_.cast("string"), F.lit("\0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, class_id, set_id, n_links.

    Words are what white space separates, in lower case; a text of fewer than SHINGLE words is
    one shingle, one without words (or null) is an empty set, which is like other empty sets
    only. set_id is the least id among the texts with the same set; class_id the least id of
    all that are connected by links, a link being a similarity of at least THRESHOLD; n_links
    the number of other rows linked to the row, its copies included. Ids that are null are
    not counted as least (a class of null ids alone has class_id null); their texts link as all
    others do. Texts of any length count whole. Rows that repeat an id, with the same text or
    another, are rows of their own. An empty table gives no rows. Further columns are not
    read. Sets are told apart by 64-bit fingerprints, shingles by 64-bit hashes.
    """
    return _classes(docs, id_col, text_col).select(F.col("_id").alias(id_col), "class_id", "set_id", "n_links")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: _id, text_hash, class_id, set_id, n_links, and keeper: (id key, text_hash) of
    the text that stands for the class, one with the least id."""
    spark = docs.sparkSession
    importable(spark)
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).withColumn("text_hash", F.xxhash64("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    sketch = written(texts.mapInArrow(lean(_sketch), f"_id {kind}, text_hash long, node long, n long, sig binary"), "sketch")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "text_hash")).alias("at")  # nulls last
    nodes = sketch.groupBy("node").agg(first, F.count("*").alias("copies"), F.max("n").alias("n"), F.first("sig").alias("sig"))
    nodes = written(nodes.select("node", F.col("at.id").alias("rep"), "at", "copies", "n", "sig"), "nodes")

    # bands: (node, band, key); only keys that two nodes have go on
    at = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    banded = nodes.where("n > 0").select("node", "sig", at)
    banded = banded.select("node", "band", F.xxhash64(F.expr(f"substring(sig, band * {2 * ROWS} + 1, {2 * ROWS})")).alias("key"))
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("node").alias("least")).where("size > 1")
    buckets = written(buckets, "buckets")
    maybe = HashFilter(buckets, ["band", "key"]).mark(banded, ["band", "key"], "_maybe").where("_maybe").drop("_maybe")
    members = join_counted(maybe, buckets, ["band", "key"], "size", maybe.count(), F.struct("node")).where("size is not null")
    members = written(members, "members")

    # places: nodes with the same least neighbour, NODE_BLOCK or so at one place
    labels = members.groupBy("node").agg(F.min("least").alias("label"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("_in"))
    places = join_counted(labels, sizes, ["label"], "_in", labels.count(), F.struct("node"))
    places = places.select("node", "label", F.pmod(F.xxhash64("node"), F.ceil(F.col("_in") / NODE_BLOCK)).alias("place"))
    places = written(places.join(nodes.select("node", "at", "copies", "sig"), "node"), "places")

    # blocks of a bucket, each with each
    g = F.ceil(F.col("size") / BUCKET_BLOCK)
    blocks = members.select("node", "band", "key", F.pmod(F.xxhash64("node", F.lit(1)), g).alias("sub"), g.alias("g"))
    blocks = blocks.withColumn("other", F.explode(F.expr("sequence(0L, g - 1L)")))
    blocks = blocks.select("node", "band", "key", "sub", F.least("sub", "other").alias("a"), F.greatest("sub", "other").alias("b"))
    blocks = blocks.join(places.select("node", "label", "place", "sig"), "node")
    keys = ["band", "key", "a", "b"]
    blocks = blocks.select(*keys, "sub", "node", "label", "place", "sig").repartition(*keys).sortWithinPartitions(*keys)
    pairs = blocks.mapInArrow(lean(_pairs), "l1 long, s1 long, l2 long, s2 long, i array<long>, j array<long>")
    pairs = pairs.groupBy("l1", "s1", "l2", "s2").agg(F.flatten(F.collect_list("i")).alias("i"), F.flatten(F.collect_list("j")).alias("j"))
    pairs = written(pairs, "pairs")

    # the sets of the nodes that are left, by place
    left = pairs.select(F.explode(F.array_union("i", "j")).alias("node")).distinct()
    wanted = places.select("node", "label", "place", "copies", _id_key(F.col("at.id")).alias("_key"), F.col("at.text_hash").alias("text_hash"))
    wanted = written(wanted.join(left, "node"), "wanted")
    one = ["_key", "text_hash"]
    chosen = HashFilter(wanted, one).mark(texts.withColumn("_key", _id_key(F.col("_id"))), one, "_maybe").where("_maybe")
    # rows that repeat id and text are one text
    chosen = chosen.groupBy(*one).agg(F.first("_text").alias("_text")).join(wanted, one).select("label", "place", "node", "copies", "_text")
    sets = chosen.groupBy("label", "place").applyInArrow(_pack_sets, "label long, place long, nodes binary, copies binary, sizes binary, sets binary")
    sets = written(sets, "sets")
    side = lambda x: sets.select(F.col("label").alias(f"l{x}"), F.col("place").alias(f"s{x}"), *[F.col(c).alias(f"{c}{x}") for c in ("nodes", "copies", "sizes", "sets")])
    same = (F.col("l1") == F.col("l2")) & (F.col("s1") == F.col("s2"))
    inside = pairs.where(same).join(side(1), ["l1", "s1"])
    inside = inside.select("i", "j", F.lit(True).alias("same"), *[F.col(f"{c}{x}") if x == 1 else F.lit(None).cast("binary").alias(f"{c}{x}") for x in (1, 2) for c in ("nodes", "copies", "sizes", "sets")])
    across = pairs.where(~same).join(side(1), ["l1", "s1"]).join(side(2), ["l2", "s2"])
    across = across.select("i", "j", F.lit(False).alias("same"), *[f"{c}{x}" for x in (1, 2) for c in ("nodes", "copies", "sizes", "sets")])
    linked = written(inside.unionByName(across).mapInArrow(lean(_verify), "node long, links long, root long"), "links")

    parts = connected_components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "rep", "at", "copies").join(links, "node", "left").join(parts, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    classes = known.groupBy("component").agg(F.min("rep").alias("class_id"), F.min("at").alias("keeper"), F.count("*").alias("_in"))
    known = join_counted(known, classes, ["component"], "_in", nodes.count(), F.struct("node"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    known = known.select("node", "copies", "class_id", F.col("rep").alias("set_id"), n_links, F.struct(_id_key(F.col("keeper.id")).alias("key"), "keeper.text_hash").alias("keeper"))
    return join_counted(sketch.select("_id", "text_hash", "node"), known, ["node"], "copies", sketch.count(), F.struct("_id", "text_hash"))


def op4_jaccard_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without all but one of each class of near duplicates.

    The text with the least id stays (of texts that share it, the one with the least hash); a
    null id is greater than any other. Rows are told apart by id and text: a row goes only for
    the class of its own text, whatever else has its id, and of rows that repeat both one
    stays. All columns stay. An empty table gives no rows.
    """
    found = _classes(docs, id_col, text_col).select(_id_key(F.col("_id")).alias("_key"), "text_hash", "keeper")
    stays = (F.col("_key") == F.col("keeper.key")) & (F.col("text_hash") == F.col("keeper.text_hash"))
    one = ["_key", "text_hash"]
    counted = found.groupBy(*one, stays.alias("_stays")).agg(F.count("*").alias("_n"))
    # most rows stay and have no like: only the others are looked up
    special = written(counted.where("not _stays or _n > 1"), "special")
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("_row"), _id_key(F.col(id_col)).alias("_key"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"))
    marked = HashFilter(special, one).mark(rows, one, "_maybe")
    looked_up = join_counted(marked.where("_maybe").drop("_maybe"), special, one, "_n", special.agg(F.sum("_n")).first()[0] or 0, F.monotonically_increasing_id())
    repeated = looked_up.where("_stays").groupBy(*one).agg(F.first("_row").alias("_row"))
    kept = marked.where("not _maybe").select("_row").unionByName(looked_up.where("_stays is null").select("_row")).unionByName(repeated.select("_row"))
    return kept.select(*[F.col(f"_row.{c}").alias(c) for c in columns])


def near_dedup_stage(spark, docs, sf_dir):
    """Pipeline stage: of each class of near duplicates one row stays, the others as they are,
    with null ids and texts and repeated rows as drop_near_duplicates() says."""
    return drop_near_duplicates(docs)
