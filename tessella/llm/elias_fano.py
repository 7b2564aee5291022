"""Elias-Fano sequences in memory-mapped files, read many places at a time with numpy."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

import numpy as np

U = np.uint64


def _or_into(words: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """words[at] |= bits, for ascending `at` with repeats."""
    if len(at):
        starts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        words[at[starts]] |= np.bitwise_or.reduceat(bits, starts)


def _byte_select() -> np.ndarray:
    """Place of the set bit number r of a byte, at 256 r + byte."""
    out = np.zeros((8, 256), np.int64)
    for byte in range(256):
        for r, place in enumerate(k for k in range(8) if byte >> k & 1):
            out[r, byte] = place
    return out.ravel()


SELECT = _byte_select()
ONES, HIGHS = U(0x0101010101010101), U(0x8080808080808080)


def _select_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the set bit number r (from 0) of each word."""
    r = r.astype(U)
    # bits set up to each byte's end, a byte each
    s = word - ((word >> U(1)) & U(0x5555555555555555))
    s = (s & U(0x3333333333333333)) + ((s >> U(2)) & U(0x3333333333333333))
    s = ((s + (s >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * ONES
    # bytes that end before the bit
    before = np.bitwise_count((((r * ONES) | HIGHS) - s) & HIGHS).astype(U) << U(3)
    before = np.minimum(before, U(56))
    r -= ((s << U(8)) >> before) & U(255)
    return before.astype(np.int64) + SELECT[((r << U(8)) | ((word >> before) & U(255))).astype(np.int64) & 2047]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending; a place of each in `keys`; and each key's number among them."""
    order = np.argsort(keys)
    found = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = found[1:] != found[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return found[new], order[new], number


class EliasFano:
    """A non-decreasing sequence of n integers below `universe`."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str):
        self.n, self.l = map(int, arrays[f"{prefix}.size"])
        self.low, self.high, self.ones, self.zeros = (arrays[f"{prefix}.{x}"] for x in ("low", "high", "ones", "zeros"))

    @staticmethod
    def encode(values: np.ndarray, universe: int, prefix: str) -> dict[str, np.ndarray]:
        n = len(values)
        bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        values = values.astype(U)
        i = np.arange(n, dtype=np.int64)
        low = np.zeros((n * bits + 63) // 64 + 1, U)
        if bits:
            part, off = values & U((1 << bits) - 1), i * bits
            at, shift = off >> 6, (off & 63).astype(U)
            _or_into(low, at, part << shift)
            _or_into(low, at + 1, (part >> U(1)) >> (U(63) - shift))
        top = (int(values[-1]) >> bits) if n else 0
        high = np.zeros((n + top + 1 + 63) // 64 + 1, U)
        place = (values >> U(bits)).astype(np.int64) + i
        _or_into(high, place >> 6, U(1) << (place & 63).astype(U))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        zeros = (np.arange(len(ones), dtype=np.int64) << 6) - ones
        return {f"{prefix}.{x}": v for x, v in (("size", np.array([n, bits])), ("low", low), ("high", high), ("ones", ones), ("zeros", zeros))}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), U)
        off = i * self.l
        at, shift = off >> 6, (off & 63).astype(U)
        both = (self.low[at] >> shift) | ((self.low[at + 1] << U(1)) << (U(63) - shift))
        return both & U((1 << self.l) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = (word << 6) + _select_in_word(self.high[word], i - self.ones[word])
        return (((place - i).astype(U) << U(self.l)) | self._low(i)).astype(np.int64)

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values i and i + 1."""
        return self.get(i), self.get(i + 1)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Places of the values, -1 where the sequence has them not: a search among the
        elements that share a value's high part."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        h = values >> self.l
        target = (values & ((1 << self.l) - 1)).astype(U)
        n_words = len(self.high)
        # where the high part's elements begin: after its h-th zero
        zeros = self.zeros
        word = np.minimum(np.searchsorted(zeros, h, side="left") - 1, n_words - 1)
        inside = (h > 0) & (h <= int(zeros[-1]))
        safe = np.where(inside, word, 0)
        place = np.where(inside, (safe << 6) + _select_in_word(~self.high[safe], np.where(inside, h - 1 - zeros[safe], 0)) + 1, 0)
        left = np.flatnonzero(inside | (h == 0))
        while len(left):
            at = place[left]
            there = at < (n_words << 6)
            left, at = left[there], at[there]
            one = (self.high[at >> 6] >> (at & 63).astype(U)) & U(1) == 1
            left, at = left[one], at[one]
            i = at - h[left]
            low = self._low(i)
            hit = low == target[left]
            out[left[hit]] = i[hit]
            go = low < target[left]
            left = left[go]
            place[left] += 1
        return out


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def save(uri: str, arrays: dict[str, np.ndarray]) -> int:
    """Writes the arrays as one file: whole or not at all, however often a task is tried."""
    system, path = _filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    head, at = {}, 0
    for name, x in arrays.items():
        head[name] = [x.dtype.str, len(x), at]
        at += -(-x.nbytes // 8) * 8
    raw = json.dumps(head).encode()
    raw += b" " * (-(len(raw) + 8) % 8)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(len(raw).to_bytes(8, "little") + raw)
        for x in arrays.values():
            out.write(np.ascontiguousarray(x).tobytes() + b"\0" * (-x.nbytes % 8))
    system.move(part, path)
    return at + len(raw) + 8


def save_json(uri: str, x: dict) -> None:
    """As save(), of a small description."""
    save(uri, {"json": np.frombuffer(json.dumps(x).encode(), np.uint8)})


def load_json(uri: str) -> dict:
    return json.loads(load(uri)["json"].tobytes())


def load(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped. A file in a store that cannot be mapped is
    copied to a nameless local file."""
    import mmap
    import shutil
    import tempfile

    from pyarrow import fs

    system, path = _filesystem(uri)
    if isinstance(system, fs.LocalFileSystem):
        file = open(path, "rb")  # noqa: SIM115
    else:
        file = tempfile.TemporaryFile()  # noqa: SIM115
        with system.open_input_stream(path) as source:
            shutil.copyfileobj(source, file)
        file.flush()
    with file:
        data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(data[:8], "little")
    head = json.loads(data[8 : 8 + size])
    return {name: np.frombuffer(data, np.dtype(kind), n, 8 + size + at) for name, (kind, n, at) in head.items()}


def shuffle_bytes(x: np.ndarray) -> bytes:
    """Compressed bytes of an array, the first bytes of all elements first."""
    import pyarrow as pa

    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unshuffle_bytes(raw: bytes, kind: type) -> np.ndarray:
    import pyarrow as pa

    n, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    flat = np.frombuffer(pa.decompress(raw[8:], n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).reshape(-1).view(kind)


def merge_counts(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    parts = list(parts)
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts]).astype(np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts
