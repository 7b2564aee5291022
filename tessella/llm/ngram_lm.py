"""N-gram language model in an Elias-Fano trie.

Level 1 holds the words, as an Elias-Fano sequence of 62-bit fingerprints, whose order numbers
them, with their counts. Level k holds the k-grams as (context, word): the context is the place of the
(k-1)-gram on the level below. Monotone pointers lead from a context to its successors; the
successor w, of m that start at place b, is the key b * V + m * w of one Elias-Fano sequence, so
that a search for w sees just the few keys with the same high part, however many successors the
context has. Each k-gram has a discounted probability, quantised to 16 bits. All are
memory-mapped files in the shared folder, cut into shards of about SHARD k-gram occurrences.

Smoothing is interpolated absolute discounting: with c counts, n distinct successors and
D = n1 / (n1 + 2 n2) of the level,

    p(w | context) = max(0, c(context w) - D) / c(context) + D n(context) / c(context) p(w | shorter context)

down to p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), so that the probabilities of all words of the
vocabulary and of one for all unknown words sum to 1. A text's end is a token; it also stands
before the first word. Two words with the same fingerprint would count as one (for V words
the chance is about V^2 / 2^63).
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, gathered, importable, lean, table, text_or_empty
from .elias_fano import U, EliasFano, distinct, load, load_json, merge_counts, save, save_json, shuffle_bytes, unshuffle_bytes

ORDER = 3
#: Occurrences in a shard of a level; text bytes for a shard of words; text bytes handled at once.
SHARD, WORD_SHARD, BLOCK = 4_000_000, 64_000_000, 3_000_000
HELD_KEYS, HELD_WORDS = 1_500_000, 1_000_000
PRINT_BITS, END = 62, 0
STEP = 16 / 65535  # of quantised -log10

#: A word's hash is the sum of LETTER[byte j] * BASE^j modulo 2^64; bytes are hashed PIECE at a time.
PIECE, BASE = 1 << 18, 0x9E3779B97F4A7C15 ^ 6
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


LETTER = _mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
LETTER[65:91] = LETTER[97:123]


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE^j and BASE^-j modulo 2^64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(PIECE + 1, base, U)
        x[0] = 1
        out.append(np.cumprod(x, dtype=U))
    return out[0], out[1]


def _hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    power, inverse = _powers()
    out = np.zeros(len(starts), U)
    k = 0
    while k < len(starts):
        low = int(starts[k])
        to = int(np.searchsorted(stops, low + PIECE, side="right"))
        if to == k:  # one word of more than PIECE bytes
            total = 0
            for at in range(low, int(stops[k]), PIECE):
                x = LETTER[data[at : min(at + PIECE, int(stops[k]))]]
                total += int((x * power[: len(x)]).sum(dtype=U)) * pow(BASE, at - low, 1 << 64)
            out[k] = total % (1 << 64)
            k += 1
            continue
        x = LETTER[data[low : stops[to - 1]]]
        sums = np.zeros(len(x) + 1, U)
        np.cumsum(x * power[: len(x)], out=sums[1:], dtype=U)
        out[k:to] = (sums[stops[k:to] - low] - sums[starts[k:to] - low]) * inverse[starts[k:to] - low]
        k = to
    return out


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all texts' tokens, and the number of tokens of each: its words between
    ASCII white space, A-Z as a-z, then END."""
    n, offsets = len(texts), np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    solid = ~SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | begins[1:-1]
    stop[:-1] &= ~solid[1:] | begins[1:-1]
    starts = np.flatnonzero(start)
    prints = (_mix(_hashes(data, starts, np.flatnonzero(stop) + 1)) >> U(64 - PRINT_BITS)).astype(np.int64)
    sizes = np.bincount(np.searchsorted(offsets, starts, side="right") - 1, minlength=n)[:n] + 1
    out = np.zeros(int(sizes.sum()), np.int64)
    words = np.ones(len(out), bool)
    words[np.cumsum(sizes) - 1] = False
    out[words] = np.maximum(prints, END + 1)
    return out, sizes


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One integer for each pair, in the order of the pairs, however large they are."""
    (_, a), (kinds, b) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
    return a * len(kinds) + b


def _merged_pairs(ctx: np.ndarray, word: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct pair, in the order of the pairs, and the sum of its counts."""
    keys = _pair_keys(ctx, word)
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return order[starts], np.add.reduceat(counts[order], starts)


def shard_of(cum: np.ndarray, count: np.ndarray, word: np.ndarray, width: int, stretch: int) -> np.ndarray:
    """Shards cut the occurrences of all contexts, in order, into equal stretches."""
    return ((cum + np.floor(count * (word / width))) // stretch).astype(np.int64)


class Level:
    """One level above the words, in shards."""

    def __init__(self, meta: dict, below: Model | Level, width: int):
        self.meta, self.below, self.width = meta, below, width
        self.shards = meta["shards"]
        self.base = np.array([s["base"] for s in self.shards] + [meta["n"]], np.int64)
        self.cum_base = np.array([s["cum"] for s in self.shards] + [meta["total"]], np.int64)
        self.known = {s["shard"]: k for k, s in enumerate(self.shards)}
        self.edges = np.array([x[0] for x in meta["edges"]], np.int64)
        self.edge_n = np.array([x[1] for x in meta["edges"]], np.int64)
        self.power = 10.0 ** (-STEP * np.arange(65536))
        self.parts: dict = {}

    def part(self, k: int):
        if k not in self.parts:
            arrays = load(self.shards[k]["file"])
            self.parts[k] = EliasFano(arrays, "pointers"), EliasFano(arrays, "keys"), EliasFano(arrays, "cum")
        return self.parts[k]

    def probs(self, k: int) -> np.ndarray:
        if ("prob", k) not in self.parts:
            self.parts["prob", k] = load(self.shards[k]["file"] + ".prob")["prob"]
        return self.parts["prob", k]

    def find(self, ctx: np.ndarray, word: np.ndarray, cum: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For ascending (ctx, word), ctx with its counts from the level below: the k-gram's
        place (or -1), its discounted probability (or 0), and the context's backoff weight."""
        place, prob, succ = np.full(len(ctx), -1, np.int64), np.zeros(len(ctx)), np.zeros(len(ctx), np.int64)
        shard = shard_of(cum, count, word, self.width, self.meta["stretch"])
        starts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1]) if len(shard) else []
        for at, to in zip(starts, [*starts[1:], len(ctx)], strict=True) if len(shard) else ():
            if (k := self.known.get(int(shard[at]))) is None:
                continue
            s, (pointers, keys, _) = self.shards[k], self.part(k)
            local = ctx[at:to] - s["ctx"]
            inside = np.flatnonzero((local >= 0) & (local < pointers.n - 1))
            if not len(inside):
                continue
            same = np.concatenate([[True], local[inside][1:] != local[inside][:-1]])
            b, e = pointers.pair(local[inside][same])
            each = np.cumsum(same) - 1
            b, m = b[each], (e - b)[each]
            succ[at + inside] = m
            i = keys.find(b * self.width + m * word[at:to][inside])
            i[m == 0] = -1
            place[at + inside] = np.where(i >= 0, s["base"] + i, -1)
            hit = np.flatnonzero(i >= 0)
            prob[at + inside[hit]] = self.power[self.probs(k)[i[hit]]]
        if len(self.edges):
            k = np.minimum(np.searchsorted(self.edges, ctx), len(self.edges) - 1)
            succ = np.where(self.edges[k] == ctx, self.edge_n[k], succ)
        return place, prob, self.meta["discount"] * succ / np.maximum(1, count)

    def counts(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences before, and of, the k-grams at ascending places."""
        cum, to = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        shard = np.searchsorted(self.base, places, side="right") - 1
        for k in np.unique(shard).tolist():
            at = shard == k
            a, b = self.part(k)[2].pair(places[at] - self.base[k])
            cum[at], to[at] = a + self.cum_base[k], b + self.cum_base[k]
        return cum, to - cum


class Model:
    """All levels, as far as they are built."""

    def __init__(self, meta: dict):
        self.meta = meta
        words = meta["words"]
        self.total, self.width = words["total"], words["n"]
        self.shards = words["shards"]
        self.shift = PRINT_BITS - words["bits"]
        self.at = {s["shard"]: k for k, s in enumerate(self.shards)}
        self.base = np.array([s["base"] for s in self.shards] + [words["n"]], np.int64)
        self.parts: dict[int, tuple] = {}
        self.levels: list[Level] = []
        for level in meta["levels"]:
            self.levels.append(Level(level, self.levels[-1] if self.levels else self, self.width))

    def part(self, k: int) -> tuple[EliasFano, EliasFano]:
        if k not in self.parts:
            arrays = load(self.shards[k]["file"])
            self.parts[k] = EliasFano(arrays, "prints"), EliasFano(arrays, "cum")
        return self.parts[k]

    def words(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For ascending fingerprints: the words' numbers (-1 for unknown ones), and the
        occurrences before and of them."""
        ids, cum, count = np.full(len(prints), -1, np.int64), np.zeros(len(prints), np.int64), np.zeros(len(prints), np.int64)
        shard = prints >> self.shift
        for s in np.unique(shard).tolist():
            if (k := self.at.get(s)) is not None:
                at = slice(*np.searchsorted(shard, [s, s + 1]).tolist())
                i = self.part(k)[0].find(prints[at] - (s << self.shift))
                ids[at] = np.where(i >= 0, self.base[k] + i, -1)
        there = ids >= 0
        cum[there], count[there] = self.counts(ids[there])
        return ids, cum, count

    def counts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences before, and of, the words at ascending numbers."""
        cum, count = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.base, ids, side="right") - 1
        for k in np.unique(shard).tolist():
            at = shard == k
            a, b = self.part(k)[1].pair(ids[at] - self.base[k])
            cum[at], count[at] = a + self.shards[k]["cum"], b - a
        return cum, count


class Walk:
    """The tokens of some texts with their contexts, level by level.

    Words and contexts have numbers within the walk, in the order of their places in the
    model, from 1; number 0 stands for all unknown ones.
    """

    def __init__(self, model: Model, tokens: np.ndarray, sizes: np.ndarray):
        kinds, _, number = distinct(np.concatenate([[END], tokens]))
        ids, cum, count = model.words(kinds)
        there = ids >= 0
        number = np.where(there, np.cumsum(there), 0)[number]
        self.model, self.word, self.context = model, number[1:], number[:-1]
        self.first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        of = lambda x, unknown: np.concatenate([[unknown], x[there]])
        self.id_of, self.count = of(ids, 0), of(count, 0)[self.word]
        # by a context's number: its place, and the occurrences before and of it
        self.ctx, self.ctx_cum, self.ctx_count = of(ids, -1), of(cum, 0), of(count, 0)

    def unigram(self) -> np.ndarray:
        n, v = self.model.total, self.model.width
        return (self.count + 0.5) / (n + 0.5 * (v + 1))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens that have a known context, and (context, word) of each as one integer."""
        use = np.flatnonzero(self.context)
        return use, self.context[use] * len(self.id_of) + self.word[use]

    def counted(self) -> tuple[np.ndarray, ...]:
        """Each distinct (context, word): their places, occurrences before and of the context,
        and how often the pair is there."""
        keys = np.sort(self.pairs()[1])
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        context, word = np.divmod(keys[starts], len(self.id_of))
        return self.ctx[context], self.id_of[word], self.ctx_cum[context], self.ctx_count[context], np.diff(starts, append=len(keys))

    def up(self, level: Level, more: bool) -> tuple[np.ndarray, np.ndarray]:
        """Discounted probability and backoff weight of each token (0 and 1 where its context
        is unknown); the contexts become those of the next level, with their counts if `more`."""
        use, key = self.pairs()
        kinds, _, inverse = distinct(key)
        context, word = np.divmod(kinds, len(self.id_of))
        # an unknown word still needs its context's weight: it is looked up as word 0, and not found
        place, prob, weight = level.find(self.ctx[context], self.id_of[word], self.ctx_cum[context], self.ctx_count[context])
        place[word == 0], prob[word == 0] = -1, 0.0
        a, b = np.zeros(len(self.word)), np.ones(len(self.word))
        a[use], b[use] = prob[inverse], weight[inverse]
        # the next level's context of a token is the k-gram that ends with the token before it
        there = place >= 0
        here = np.zeros(len(self.word), np.int64)
        here[use] = np.where(there, np.cumsum(there), 0)[inverse]
        self.context = np.concatenate([[0], here[:-1]])
        self.context[self.first] = 0
        self.ctx = np.concatenate([[-1], place[there]])
        self.ctx_cum, self.ctx_count = np.zeros(len(self.ctx), np.int64), np.zeros(len(self.ctx), np.int64)
        if more:
            self.ctx_cum[1:], self.ctx_count[1:] = level.counts(place[there])
        return a, b


@lru_cache(maxsize=1)
def _model(path: str) -> Model:
    return Model(load_json(path))


def _grouped(rows: DataFrame, build, fields: str) -> list:
    """One call of build(bucket, blobs) a bucket, where Spark gathers the bucket's blobs; one
    row for each shard comes to the driver."""
    names = rows.columns[1:]

    def run(key, found):  # without hints: else all need them
        out = build(key[0].as_py(), list(zip(*(found.column(c).to_pylist() for c in names), strict=True)))
        return pa.Table.from_pylist([out], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(fields))
    return sorted(rows.groupBy("bucket").applyInArrow(run, fields).collect(), key=lambda r: r["shard"])


def _emit(bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Blobs of the columns, the first of which ascends, cut where the (ascending) bucket changes."""
    starts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1]).tolist() if len(bucket) else []
    out: list[list] = [[] for _ in range(len(columns) + 1)]
    for at, to in zip(starts, [*starts[1:], len(bucket)], strict=False):
        out[0].append(int(bucket[at]))
        for k, x in enumerate(columns, 1):
            out[k].append(shuffle_bytes(np.diff(x[at:to], prepend=0) if k == 1 else x[at:to]))
    names = ["bucket", *[f"c{k}" for k in range(len(columns))]]
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(x, pa.binary()) for x in out[1:]]], names)


def _unpacked(blobs: list[tuple]) -> list[np.ndarray]:
    """The columns of all blobs."""
    parts = [[np.cumsum(unshuffle_bytes(x, np.int64)) if k == 0 else unshuffle_bytes(x, np.int64) for k, x in enumerate(row)] for row in blobs]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _build_words(train: DataFrame, folder: str) -> dict:
    size = train.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    bits = max(0, (-(-size // WORD_SHARD) - 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def out() -> pa.RecordBatch:
            prints, counts = merge_counts(held)
            return _emit(prints >> (PRINT_BITS - bits), prints, counts)

        for batch in gathered(batches, 0, BLOCK):
            held.append(np.unique(tokens_of(batch.column(0))[0], return_counts=True))
            n += len(held[-1][0])
            if n >= HELD_WORDS:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    def build(shard: int, blobs) -> dict:
        prints, counts = merge_counts([tuple(_unpacked(blobs))])
        file = f"{folder}/words-{shard}"
        shift = PRINT_BITS - bits
        arrays = EliasFano.encode(prints - (shard << shift), 1 << shift, "prints") | EliasFano.encode(np.concatenate([[0], np.cumsum(counts)]), int(counts.sum()) + 1, "cum")
        save(file, arrays)
        return {"shard": shard, "file": file, "n": len(prints), "total": int(counts.sum())}

    rows = train.mapInArrow(lean(count), "bucket long, c0 binary, c1 binary")
    shards, n, total = [], 0, 0
    for r in _grouped(rows, build, "shard long, file string, n long, total long"):
        shards.append(r.asDict() | {"base": n, "cum": total})
        n, total = n + r["n"], total + r["total"]
    return {"shards": shards, "n": n, "total": total, "bits": bits}


def _build_level(train: DataFrame, meta: dict, folder: str) -> dict:
    spark, known = train.sparkSession, f"{folder}/model-{len(meta['levels'])}.json"
    save_json(known, meta)
    k, total, width = len(meta["levels"]) + 2, meta["words"]["total"], meta["words"]["n"]
    stretch = max(1, -(-total // max(1, round(total / SHARD))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(known)
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def out() -> pa.RecordBatch:
            ctx, word, bucket, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            at, counts = _merged_pairs(ctx, word, counts)
            return _emit(bucket[at], ctx[at], word[at], counts)

        for batch in gathered(batches, 0, BLOCK):
            walk = Walk(model, *tokens_of(batch.column(0)))
            for level in model.levels:
                walk.up(level, True)
            ctx, word, before, of, counts = walk.counted()
            held.append((ctx, word, shard_of(before, of, word, width, stretch), counts))
            n += len(ctx)
            if n >= HELD_KEYS:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def build(shard: int, blobs) -> dict:
        ctx, word, counts = _unpacked(blobs)
        at, counts = _merged_pairs(ctx, word, counts)
        ctx, word = ctx[at], word[at]
        low = int(ctx[0])
        pointers = np.concatenate([[0], np.cumsum(np.bincount(ctx - low))])
        n_of = np.diff(pointers)
        b, m = pointers[ctx - low], n_of[ctx - low]
        file = f"{folder}/level{k}-{shard}"
        arrays = EliasFano.encode(pointers, len(ctx) + 1, "pointers")
        arrays |= EliasFano.encode(b * width + m * word, len(ctx) * width + 1, "keys")
        arrays |= EliasFano.encode(np.concatenate([[0], np.cumsum(counts)]), int(counts.sum()) + 1, "cum")
        save(file, arrays)
        return {
            "shard": shard, "file": file, "n": len(ctx), "total": int(counts.sum()), "ctx": low,
            "first": int(n_of[0]), "last_ctx": int(ctx[-1]), "last": int(n_of[-1]), "ones": int((counts == 1).sum()), "twos": int((counts == 2).sum()),
        }

    rows = train.mapInArrow(lean(count), "bucket long, c0 binary, c1 binary, c2 binary")
    fields = "shard long, file string, n long, total long, ctx long, first long, last_ctx long, last long, ones long, twos long"
    shards, n, occurrences, edges = [], 0, 0, Counter()
    ones = twos = 0
    for r in _grouped(rows, build, fields):
        shards.append(r.asDict() | {"base": n, "cum": occurrences})
        n, occurrences, ones, twos = n + r["n"], occurrences + r["total"], ones + r["ones"], twos + r["twos"]
        edges[r["ctx"]] += r["first"]
        if r["last_ctx"] != r["ctx"]:
            edges[r["last_ctx"]] += r["last"]
    discount = min(0.99, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
    level = {"shards": shards, "n": n, "total": occurrences, "edges": sorted(edges.items()), "discount": discount, "stretch": stretch}
    if shards:
        _quantise(spark, level, known)
    return level


def _quantise(spark, level: dict, known: str) -> None:
    """Writes each shard's discounted probabilities, which need the level's discount."""
    discount = level["discount"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(known)
        for batch in batches:
            for s in batch.to_pylist():
                arrays = load(s["file"])
                pointers, cum = EliasFano(arrays, "pointers"), EliasFano(arrays, "cum")
                each = np.repeat(np.arange(pointers.n - 1), np.diff(pointers.get(np.arange(pointers.n))))
                there = np.unique(each)
                total = np.zeros(pointers.n - 1)
                total[there] = (model.levels[-1] if model.levels else model).counts(there + s["ctx"])[1]
                count = np.diff(cum.get(np.arange(cum.n)))
                prob = np.round(-np.log10((count - discount) / total[each]) / STEP)
                save(s["file"] + ".prob", {"prob": np.clip(prob, 0, 65535).astype(np.uint16)})
            yield batch

    rows = spark.createDataFrame([(s["file"], s["ctx"]) for s in level["shards"]], "file string, ctx long")
    rows.repartition(max(1, len(level["shards"]))).mapInArrow(lean(run), rows.schema).count()


def train_model(docs: DataFrame, order: int = ORDER, text_col: str = "text") -> str:
    """Trains on all rows of `docs`; the path of the model's description, for score_texts()."""
    importable(docs.sparkSession)
    train = docs.select(text_or_empty(text_col).alias("_text"))
    folder = fresh_path(docs.sparkSession, "ngrams")
    meta: dict = {"words": _build_words(train, folder), "levels": []}
    for _ in range(order - 1 if meta["words"]["n"] else 0):
        meta["levels"].append(_build_level(train, meta, folder))
    save_json(f"{folder}/model.json", meta)
    return f"{folder}/model.json"


def score_block(model: Model, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per text: known tokens, log10 of the unigram base and of the model's probability."""
    walk = Walk(model, tokens, sizes)
    p = walk.unigram()
    base, known = np.log10(p), walk.word > 0
    for k, level in enumerate(model.levels, 1):
        a, b = walk.up(level, k < len(model.levels))
        p = a + b * p
    starts = np.cumsum(sizes) - sizes
    return tuple(np.add.reduceat(x, starts) for x in (known.astype(np.int64), base, np.log10(p)))


def score_texts(docs: DataFrame, model_path: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score to each row.

    A null text counts as empty: it has one token, its end. An empty table gives no rows. Null
    ids, repeated rows and further columns (`carry`, default all) pass as they are; columns
    named like the new ones are replaced. Texts of any length are scored whole. With nothing
    learned every token has probability 1.
    """
    importable(docs.sparkSession)
    new = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}
    carry = [c for c in (docs.columns if carry is None else carry) if c not in new]
    rows = docs.select(F.struct(*carry).alias("_row"), text_or_empty(text_col).alias("_text"))
    schema = rows.select("_row").schema
    for name, kind in new.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        for batch in gathered(batches, 1, BLOCK):
            tokens, sizes = tokens_of(batch.column(1))
            known, base, score = score_block(model, tokens, sizes)
            columns = [pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), model.total)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_row", *new])

    return rows.mapInArrow(lean(run), schema).select(*[F.col(f"_row.{c}").alias(c) for c in carry], *new)


def op2_ngram_lm(spark, sf_dir):
    from .langid import id_hash

    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_hash() % 5 == 1)
    model_path = train_model(docs.where("not held_out"))
    return score_texts(docs, model_path, carry=["doc_id", "held_out"])
