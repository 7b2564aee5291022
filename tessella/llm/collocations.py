"""Phrase collocations: n-grams of frequent words as fixed-width binary keys, sorted and counted by runs.

1. Words are counted, and those found often enough make the dictionary; a phrase found that often has no others.
2. Each occurrence of a word gives one key: its number and those of up to three words that follow it in
   the piece, with zeros from where the piece or the run of frequent words ends. Sorted keys have all
   phrases of two, three and four words that begin alike side by side, as prefixes.
3. Tasks radix-sort what they read and count equal keys before anything is shuffled; the counted
   keys are cut into ranges, sorted, and read once as runs of equal prefixes. Only the first and
   the last run of a range can go on elsewhere; all others are complete and go if they are rare.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BUCKET_BITS, MAX_FILTER_BITS, gathered, importable, join_counted, lean, sliced, table, text_or_empty, written
from .ngram_lm import _hashes, _mix

U = np.uint64
LONGEST = 4  # words of a phrase
#: Words whose numbers tasks get as one sorted array (32 MB); with more, words go by 64-bit fingerprints.
DICTIONARY = 1 << 22
#: Bytes of text handled, keys sorted, and counted keys in a range, at once.
BLOCK, HELD, RANGE = 3_000_000, 1_000_000, 4_000_000
BUCKET_ROWS = 50_000  # ranked at once

SPACE, BREAK = np.zeros(256, bool), np.zeros(256, bool)
SPACE[[0x20, 0x09]] = True
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


def words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch (lang, text): the texts' bytes, where words start, where they stop, and whether the
    next word follows in the same piece."""
    texts = batch.column(1)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    ends = BREAK[data]
    solid = ~(SPACE[data] | ends)
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | begins[1:-1]
    stop[:-1] &= ~solid[1:] | begins[1:-1]
    starts = np.flatnonzero(start)
    piece = np.cumsum(ends)[starts] if len(starts) else starts
    text = np.searchsorted(offsets, starts, side="right") - 1
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    return data, starts, np.flatnonzero(stop) + 1, follows


def prints_of(batch: pa.RecordBatch, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Fingerprints of (language, word), A-Z as a-z; never 0."""
    langs = batch.column(0).dictionary_encode()
    seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in langs.dictionary.to_pylist()] or [0], U)
    texts = batch.column(1)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    text = np.searchsorted(offsets - offsets[0], starts, side="right") - 1
    own = seeds[langs.indices.to_numpy()][text] if len(text) else np.zeros(0, U)
    return np.maximum(_mix(_hashes(data, starts, stops) ^ own), U(1))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, print, n) of each block of texts."""
    for batch in gathered(batches, 1, BLOCK):
        data, starts, stops, _ = words_of(batch)
        prints, first, n = np.unique(prints_of(batch, data, starts, stops), return_index=True, return_counts=True)
        sizes = stops[first] - starts[first]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[first] - (ends - sizes), sizes)
        letters = data[at]
        letters = np.where((letters >= 65) & (letters <= 90), letters + 32, letters).astype(np.uint8)
        word = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(letters))
        texts = batch.column(1)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        lang = batch.column(0).take(pa.array(np.searchsorted(offsets - offsets[0], starts[first], side="right") - 1))
        yield pa.RecordBatch.from_arrays([lang, word, pa.array(prints.view(np.int64)), pa.array(n)], ["lang", "word", "print", "n"])


def numbers(known: np.ndarray, dense: bool) -> Callable[[np.ndarray], np.ndarray]:
    """From fingerprints to numbers, 0 for a word that is not frequent.

    dense: `known` are the sorted fingerprints of the frequent words, and a word's number is its place
    there. Else they are the bytes of a bit set, and the fingerprint is the number; a rare
    word that a bit lets through has rare phrases only, which are not reported.
    """
    if dense:

        def find(prints: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(known, prints), max(0, len(known) - 1))
            return np.where(known[at] == prints, at + 1, 0).astype(U) if len(known) else np.zeros(len(prints), U)
    else:

        def find(prints: np.ndarray) -> np.ndarray:
            place = (prints & U(8 * len(known) - 1)).astype(np.int64)
            return np.where(known[place >> 3] >> (place & 7).astype(np.uint8) & 1, prints, U(0))

    return find


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Stable order by the columns, the first one first: digits of 16 bits from the last one on; those
    that are the same in all rows are passed over."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in range(0, 64, 16):
            digit = (column >> U(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def packed(columns: list[np.ndarray], width: int) -> pa.Array:
    """Rows of numbers as binary keys of `width` bytes a number, whose order is that of the rows."""
    rows = np.ascontiguousarray(np.stack(columns, 1).astype(f">u{width}"))
    size = width * len(columns)
    offsets = (np.arange(len(rows) + 1) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _runs(changes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs start, of rows that differ from the one before where `changes`, and the sums of n."""
    starts = np.flatnonzero(changes)
    return starts, np.add.reduceat(n, starts) if len(starts) else n[:0]


def _encode(find_of: Callable, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held, size = find_of(), [], 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            order = radix_order(columns)
            columns = [c[order] for c in columns]
            changes = np.ones(len(order), bool)
            changes[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            starts, n = _runs(changes, np.ones(len(order), np.int64))
            return pa.RecordBatch.from_arrays([packed([c[starts] for c in columns], width), pa.array(n)], ["key", "n"])

        for batch in sliced(gathered(batches, 1, BLOCK), 1, BLOCK):
            data, starts, stops, follows = words_of(batch)
            ids = find(prints_of(batch, data, starts, stops))
            more = np.concatenate([ids, np.zeros(LONGEST, U)])
            pair = np.zeros(len(ids) + LONGEST, bool)
            pair[: len(ids)] = follows & (ids > 0) & (more[1 : len(ids) + 1] > 0)
            at, whole, key = np.flatnonzero(pair), np.ones(int(pair.sum()), bool), []
            for k in range(1, LONGEST):
                whole = whole & pair[at + k - 1]
                key.append(np.where(whole, more[at + k], U(0)))
            held.append([ids[at], *key])
            size += len(at)
            if size >= HELD:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _prefix_runs(width: int, least: int) -> Callable:
    """From sorted (key, n): (key, words, n) of each prefix of 2 to LONGEST words whose run is complete
    and frequent, or may go on in another range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple] = {}  # by words of the prefix: the run that is open
        first = dict.fromkeys(range(2, LONGEST + 1), True)  # no run has been closed

        def made(words: int, prefixes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            columns = [prefixes[:, k] if k < words else np.zeros(len(n), U) for k in range(LONGEST)]
            return pa.RecordBatch.from_arrays([packed(columns, width), pa.array(np.full(len(n), words, np.int32)), pa.array(n)], ["key", "words", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            at = int(np.frombuffer(keys.buffers()[1], np.int32)[keys.offset])
            ids = np.frombuffer(keys.buffers()[2], np.uint8)[at : at + len(keys) * width * LONGEST].view(f">u{width}").reshape(-1, LONGEST).astype(U)
            n = batch.column(1).to_numpy()
            changed = np.zeros(len(ids), bool)
            changed[0] = True
            changed[1:] = ids[1:, 0] != ids[:-1, 0]
            for words in range(2, LONGEST + 1):
                changed[1:] |= ids[1:, words - 1] != ids[:-1, words - 1]
                starts, sums = _runs(changed, n)
                prefixes = ids[starts, :words]
                if words in last:
                    if (last[words][0] == prefixes[0]).all():
                        sums[0] += last[words][1]
                    else:
                        prefixes, sums = np.concatenate([last[words][0][None], prefixes]), np.concatenate([[last[words][1]], sums])
                last[words] = prefixes[-1], int(sums[-1])
                keep = (sums >= least) & (prefixes[:, -1] > 0)
                if len(sums) > 1:
                    keep[0] |= first[words] and bool(prefixes[0, -1] > 0)
                    first[words] = False
                keep[-1] = False
                if keep.any():
                    yield made(words, prefixes[keep], sums[keep])
        for words, (prefix, n) in last.items():
            if prefix[-1] > 0:
                yield made(words, prefix[None], np.array([n], np.int64))

    return run


def _cut(first: int | str, words: int | str, width: int) -> F.Column:
    """The key of some of a phrase's words."""
    return F.expr(f"rpad(substring(key, cast(({first}) * {width} + 1 as int), cast(({words}) * {width} as int)), {width * LONGEST}, X'00')")


def _with_counts(rows: DataFrame, column: str, counts: DataFrame, name: str) -> DataFrame:
    """Adds the count of the key in `column`; one key may stand in any number of rows."""
    found = rows.groupBy(column).agg(F.count("*").alias("_rows")).join(counts.withColumnRenamed("key", column), column)
    return join_counted(rows, found.withColumnRenamed("n", name), [column], "_rows", rows.count(), F.struct("key")).drop("_rows")


def collocations(docs: DataFrame, least: int = 30, top: int | None = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the `top` best phrases of each language (null: all).

    Texts, A-Z lower-cased, are cut at `.,;:!?` and line ends into pieces, and these at blanks
    and tabs into words; a null text is empty, a null language is `und`. All counts are of a language: a of the phrase, with
    overlaps; l and r of its parts at the cut of the lowest score, floor(2000000 a / (l + r)), the
    first of equal ones; n of all words. Phrases of 2 to 4 words with a >= least are ranked by score,
    a, phrase; one inside a longer one with 100 f(longer) >= 80 a goes. Texts may be of any length and rows may repeat: each
    counts. An empty table gives no rows; other columns are not read. Words are told apart by
    64-bit fingerprints.
    """
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    counted = rows.mapInArrow(lean(_count_words), "lang string, word string, print long, n long")
    counted = written(counted.groupBy("lang", "word").agg(F.min("print").alias("print"), F.sum("n").alias("n")), "words")
    frequent = counted.where(F.col("n") >= least)
    dense = frequent.count() <= DICTIONARY
    width = 4 if dense else 8
    if dense:
        known = np.sort(np.array([r[0] for r in frequent.select("print").distinct().collect()], np.int64).view(U))
    else:
        place = F.col("print").bitwiseAND(MAX_FILTER_BITS - 1)
        maps = frequent.select(F.floor(place / BUCKET_BITS).alias("b"), (place % BUCKET_BITS).alias("p")).groupBy("b").agg(F.expr("bitmap_construct_agg(p)").alias("bits"))
        known = np.zeros(MAX_FILTER_BITS // 8, np.uint8)
        for b, bits in maps.toLocalIterator():  # 16 MB at most
            known[b * BUCKET_BITS // 8 : (b + 1) * BUCKET_BITS // 8] = np.frombuffer(bits, np.uint8)
    shared = spark.sparkContext.broadcast(known)
    find_of = lambda: numbers(shared.value, dense)

    def number_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = find_of()
        for b in batches:
            ids, none = find(b.column(2).to_numpy().view(U)), np.zeros(b.num_rows, U)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed([ids, *[none] * (LONGEST - 1)], width), b.column(3)], ["lang", "word", "key", "n"])

    words = written(frequent.mapInArrow(lean(number_words), "lang string, word string, key binary, n long"), "dictionary")
    keys = written(rows.mapInArrow(lean(_encode(find_of, width)), "key binary, n long"), "keys")
    ranges = max(1, -(-keys.count() // RANGE), spark.sparkContext.defaultParallelism)
    runs = keys.repartitionByRange(ranges, "key").sortWithinPartitions("key").mapInArrow(lean(_prefix_runs(width, least)), "key binary, words int, n long")
    phrases = written(runs.groupBy("key", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")

    # the most frequent longer phrase around each
    inside = F.array(*[F.when(F.expr(f"{first} + {size} <= words and {size} < words"), _cut(first, size, width)) for size in range(2, LONGEST) for first in range(LONGEST - size + 1)])
    longer = phrases.where("words > 2").select(F.explode(F.array_compact(inside)).alias("key"), F.col("n").alias("_longer")).groupBy("key").agg(F.max("_longer").alias("_longer"))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    left = written(phrases.join(longer, "key", "left").where(F.col("_longer").isNull() | (100 * big("_longer") < 80 * big("n"))).drop("_longer"), "candidates")

    cuts = left.select("key", "words", F.col("n").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("key", "a", "k", _cut(0, "k", width).alias("_l"), _cut("k", "words - k", width).alias("_r"))
    counts = phrases.select("key", "n").unionByName(words.select("key", "n"))
    cuts = _with_counts(_with_counts(cuts, "_l", counts, "l"), "_r", counts, "r")
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r)")
    scored = cuts.withColumn("score", score).groupBy("key").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("_s"))

    parts = left.select("key", F.posexplode(F.expr("sequence(0, words - 1)")).alias("_at", "_k")).select("key", "_at", _cut("_k", "1", width).alias("_word"))
    found = parts.groupBy("_word").agg(F.count("*").alias("_rows")).join(words.select(F.col("key").alias("_word"), "lang", "word"), "_word")
    named = join_counted(parts, found, ["_word"], "_rows", parts.count(), F.struct("key"))
    text = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]))
    phrase = named.groupBy("key").agg(F.first("lang").alias("lang"), text.alias("phrase"))
    out = written(scored.join(phrase, "key").select("lang", "phrase", "_s.*"), "scored")

    order = "score desc, a desc, phrase"
    if top is not None:
        buckets = -(-out.count() // BUCKET_ROWS)
        while buckets > 1:  # the best of each part of a language hold the best of all
            rank = F.expr(f"row_number() over (partition by lang, pmod(xxhash64(phrase), {buckets}) order by {order})")
            out, buckets = out.withColumn("_rank", rank).where(F.col("_rank") <= top).drop("_rank"), buckets // 8
    out = out.withColumn("rank", F.expr(f"row_number() over (partition by lang order by {order})").cast("long"))
    if top is not None:
        out = out.where(F.col("rank") <= top)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs
), words AS (
  SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM words, (VALUES (1), (2), (3), (4)) AS s(k) WHERE len(w) >= k
), f AS (
  SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 30
), longer AS (
  SELECT lang, g[first:first + size - 1] AS g, max(f) AS most
  FROM f, (VALUES (1), (2), (3)) AS a(first), (VALUES (2), (3)) AS b(size) WHERE size < len(g) AND first + size - 1 <= len(g) GROUP BY 1, 2
), kept AS (
  SELECT f.lang, f.g, f.f AS a FROM f LEFT JOIN longer USING (lang, g) WHERE len(f.g) >= 2 AND (most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(f.f AS HUGEINT))
), cuts AS (
  SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, CAST((2000000 * CAST(c.a AS HUGEINT)) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM kept c JOIN (VALUES (1), (2), (3)) AS s(k) ON k < len(c.g)
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:len(c.g)]
), scored AS (
  SELECT *, array_to_string(g, ' ') AS phrase FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
