"""Order-preserving packing of documents into token sequences by dynamic programming.

Documents follow each other in the order of their table; cuts may fall at document ends
(free), sentence ends (CUT_SENTENCE tokens' worth of penalty) or, in a sentence of more than
STRIDE ids, after each STRIDE of them (CUT_INSIDE). A sequence of n ids is padded to WINDOW unless n is a power of two.
With f(i) the least cost of the ids before cut i, and p(i) its penalty,

    f(i) = p(i) + min( min over i - WINDOW <= j < i of f(j) - (i - j) + WINDOW,
                       min over powers of two k with a cut at i - k of f(i - k) )

where the first minimum is that of f(j) + j over a sliding window, kept in a monotone queue.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LATIN_WORDS, byte_letters
from .common import importable, lean, table, text_or_empty

WINDOW = 2048
END_ID = 1
CUT_SENTENCE, CUT_INSIDE, STRIDE = 6, 24, 64
#: Ids that are gathered before they are cut; what follows the last but KEEP windows is cut again.
CHUNK, KEEP = 1 << 18, 8
SENTENCE_ENDS = ".!?"
CACHED_WORDS, BLOCK_CHARS = 240_000, 500_000


def best_cuts(cuts: list[int], penalty: list[int], window: int = WINDOW) -> list[int]:
    """Chosen positions, from cuts[0] to cuts[-1], of least total cost.

    `cuts` ascend, with no gap above `window`.
    """
    n, at = len(cuts), np.array(cuts)
    # (i, j) for which cuts[i] - cuts[j] is a power of two, by i
    exact = []
    for k in range(window.bit_length()):
        if 1 << k <= window:
            j = np.searchsorted(at, at - (1 << k))
            i = np.flatnonzero(at[j] == at - (1 << k))
            exact.append(np.stack([i, j[i]]))
    pairs = np.concatenate(exact, axis=1)
    pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
    ends, starts, next_pair = [*pairs[0].tolist(), n], pairs[1].tolist(), 0
    cost, back = [0] * n, [0] * n
    keys, heads = deque([cuts[0]]), deque([0])  # f(j) + j, ascending, and j
    for i in range(1, n):
        x = cuts[i]
        while cuts[heads[0]] < x - window:
            heads.popleft()
            keys.popleft()
        least, came = keys[0] + window - x, heads[0]
        while ends[next_pair] == i:
            j = starts[next_pair]
            next_pair += 1
            if cost[j] < least:
                least, came = cost[j], j
        least += penalty[i]
        cost[i], back[i] = least, came
        key = least + x
        while keys and keys[-1] >= key:
            keys.pop()
            heads.pop()
        keys.append(key)
        heads.append(i)
    out, i = [cuts[-1]], n - 1
    while i:
        i = back[i]
        out.append(cuts[i])
    return out[::-1]


def _tail(left: int, window: int) -> list[int]:
    """Lengths for the last ids of a partition: one padded sequence, or powers of two
    (which are not padded) where the cuts that these need cost less than the padding."""
    powers = [1 << k for k in reversed(range(left.bit_length())) if left >> k & 1]
    return powers if 0 < left < window and (len(powers) - 1) * CUT_INSIDE < window - left else [left] if left else []


class _Packer:
    """Cuts the ids of one partition as they come; holds about CHUNK of them."""

    def __init__(self, part: int, ends_sentence: np.ndarray, window: int):
        self.base, self.count = part << 40, 0
        self.ends, self.window = ends_sentence, window
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # (doc_id, ids of it already packed, its ids in all, its ids here)
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, 0, len(ids), len(ids)))
        self.held += len(ids)
        if self.held >= CHUNK:
            self.pack(False)

    def pack(self, last: bool) -> None:
        if not self.held:
            return
        ids = np.concatenate(self.ids)
        n, stops = len(ids), np.cumsum([d[3] for d in self.docs])
        penalty = np.full(n + 1, -1, np.int64)
        penalty[np.flatnonzero(self.ends[ids]) + 1] = CUT_SENTENCE
        penalty[stops] = 0
        penalty[0] = penalty[n] = 0
        cuts = np.flatnonzero(penalty >= 0)
        long = np.flatnonzero(np.diff(cuts) > STRIDE).tolist()
        for a, b in zip(cuts[long].tolist(), cuts[[k + 1 for k in long]].tolist(), strict=True):
            penalty[a + STRIDE : b : STRIDE] = CUT_INSIDE
        cuts = np.flatnonzero(penalty >= 0)
        chosen = best_cuts(cuts.tolist(), penalty[cuts].tolist(), self.window)
        if last:
            start = chosen[-2] if len(chosen) > 1 else 0
            chosen = chosen[:-1] + [start + x for x in np.cumsum(_tail(n - start, self.window)).tolist()]
        else:
            chosen = chosen[:-KEEP]
        self.emit(ids, stops, chosen)
        done = chosen[-1]
        self.ids, self.held = [ids[done:]], n - done
        docs = []
        for (doc_id, before, total, here), stop in zip(self.docs, stops.tolist(), strict=True):
            if stop > done:
                packed = max(0, here - (stop - done))
                docs.append((doc_id, before + packed, total, here - packed))
        self.docs = docs

    def emit(self, ids: np.ndarray, stops: np.ndarray, chosen: list[int]) -> None:
        raw, starts = memoryview(ids.astype("<u4").tobytes()), [0, *stops[:-1].tolist()]
        k = 0
        for at, to in zip(chosen, chosen[1:], strict=False):
            x = at
            while x < to:
                while stops[k] <= x:
                    k += 1
                y = min(to, int(stops[k]))
                doc_id, before, total, _ = self.docs[k]
                self.rows.append((doc_id, before + x - starts[k], y - x, zlib.crc32(raw[4 * x : 4 * y]), total, self.base + self.count, x - at))
                x = y
            self.count += 1


class TokenizerWords:
    """Ids of texts, as bytes. Words met lately are looked up; those that are new in a block of
    texts go to the library's BPE model, without its normalizer and pre-splitter, as they are
    normal and split already."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def plain(self, text: str) -> bool:
        """Whether lower-casing and LATIN_WORDS do what the vocabulary's own steps do."""
        if any(x in text for x in self.special):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def encode(self, texts: list[str]) -> list[bytes]:
        words: list[str] = []
        spans: list[tuple[int, int] | None] = []
        for text in texts:
            if self.plain(text):
                at = len(words)
                words += LATIN_WORDS.findall(text.lower())
                spans.append((at, len(words)))
            else:
                spans.append(None)
        found = list(map(self.words.get, words))
        if None in found:
            self._learn({w for w, x in zip(words, found, strict=True) if x is None})
            found = list(map(self.words.__getitem__, words))
        whole = lambda text: array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        out = [whole(text) if span is None else b"".join(found[span[0] : span[1]]) for text, span in zip(texts, spans, strict=True)]
        if len(self.words) > CACHED_WORDS:
            self.old, self.words = self.words, {}
        return out

    def _learn(self, missing: set[str]) -> None:
        for word in missing:
            if (x := self.old.get(word)) is None:
                letters = word if word.isascii() and word.isalpha() else "".join([self.letters[b] for b in word.encode()])
                x = array("I", [t.id for t in self.merge(letters)]).tobytes()
            self.words[word] = x


def _ids_encoder(path: str) -> tuple[TokenizerWords, np.ndarray]:
    encoder = TokenizerWords(path)
    vocab = encoder.tokenizer.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    for token, i in vocab.items():
        mark = token.removesuffix("</w>")
        ends[i] = bool(mark) and mark[0] in SENTENCE_ENDS and token != mark
    return encoder, ends


SCHEMA = [
    ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
]


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's, then END_ID; a null or empty text has END_ID alone, so
    that every row of `docs`, repeated ones and those with a null id too, has at least one
    piece. Each partition is packed by itself in the order of its rows, with no shuffle;
    sequence_id holds the partition's number above bit 40. A text of any length is held whole
    while it is cut, with about CHUNK other ids. An empty table gives no rows. Other columns
    are left out, so that none can clash.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ends = _ids_encoder(path)
        end = array("I", [END_ID]).tobytes()
        packer, kind = _Packer(TaskContext.get().partitionId(), ends, window), None

        def ready() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) if packer.rows else [[]] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), *(pa.array(c, t) for c, (_, t) in zip(columns[1:], SCHEMA, strict=True))], [id_col, *(n for n, _ in SCHEMA)]
            )

        for batch in batches:
            kind = batch.column(0).type
            ids, at = batch.column(0).to_pylist(), 0
            while at < len(ids):
                texts, held, first = [], 0, at
                while at < len(ids) and held < BLOCK_CHARS:
                    texts.append(batch.column(1)[at].as_py())
                    held += len(texts[-1])
                    at += 1
                for doc_id, raw in zip(ids[first:at], encoder.encode(texts), strict=True):
                    packer.add(doc_id, np.frombuffer(raw + end, np.uint32))
            if len(packer.rows) > 10_000:
                yield ready()
        packer.pack(True)
        if packer.rows:
            yield ready()

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n, _ in SCHEMA))


def op1_packing(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def packing_stage(spark, docs, sf_dir):
    """Pipeline stage, the last: the pieces of the documents in sequences, as pack() gives them:
    a null or empty text has its end alone, repeated rows are packed as often, and an empty
    table gives no rows."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
