"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.tables import fresh_path, join_counted, shared_dir, written  # noqa: F401, for the operators

#: Spark's settings of Arrow batches: their defaults, and what rows with whole texts need.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(4 << 20))}
#: Workers share an executor's memory: what they free goes back at once.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2"}


def importable(spark: SparkSession) -> None:
    """Prepares the session for Python workers: they can import this package from where the
    driver did, as where it is not installed but lies in a folder that all have; and they get
    smaller batches, unless the session asks for another size than the default."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    for name, (default, ours) in BATCHES.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a mapInArrow, giving its memory back at the end: workers wait, idle,
    beside those of the next stage, and should hold nothing of what they did before."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        release()

    return run


def gathered(batches: Iterator[pa.RecordBatch], column: int, least: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until `column` has about `least` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def sliced(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut between rows so that the strings of `column` have at most `most` bytes in each, or are one."""
    for batch in batches:
        texts = batch.column(column)
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small fixed table, as a literal of the plan."""
    made = [F.struct(*[F.lit(x).alias(n) for x, n in zip(row, names, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*made)))


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def running(values: Column, op, zero: Column, kind: str = "int", chunk: int = 512) -> Column:
    """Array of op over the values up to each. Results are appended chunk by chunk, so that
    no append copies more than `chunk` of them."""

    def chain(x: Column, start: Column, inclusive: bool) -> Column:
        step = lambda acc, v: op(acc["at"], v)
        return F.aggregate(
            x,
            F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
            lambda acc, v: F.struct(step(acc, v).alias("at"), F.concat(acc["out"], F.array(step(acc, v) if inclusive else acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )

    def of(chunks: Column) -> Column:
        bases = chain(F.transform(chunks, lambda c: F.aggregate(c, zero, op)), zero, False)
        return F.flatten(F.zip_with(chunks, bases, lambda c, b: chain(c, b, True)))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int") + F.when(F.size(v) == 0, 1).otherwise(0)), lambda k: F.slice(v, k * chunk + 1, F.lit(chunk)))
    # each is computed once: a lambda's variable is computed before its body
    once = lambda x, f: F.transform(F.array(x), f)[0]
    return once(values, lambda v: once(cut(v), of))


BUCKET_BITS = 32768  # of Spark's bitmap functions
MAX_FILTER_BITS = 1 << 27


class HashFilter:
    """A bit set over the hashes of some keys, small enough to broadcast.

    It has about 8 bits a key and never more than MAX_FILTER_BITS (16 MB), however many keys
    there are. A bit set by chance only lets a row through that a join behind it drops.
    """

    def __init__(self, keys: DataFrame, columns: list[str]):
        buckets, n = 1, keys.count()
        while buckets * BUCKET_BITS < min(8 * n, MAX_FILTER_BITS):
            buckets *= 2
        self.bits = buckets * BUCKET_BITS
        place = self._place(*columns)
        self.maps = (
            keys.select(F.floor(place / BUCKET_BITS).cast("int").alias("_bucket"), F.pmod(place, F.lit(BUCKET_BITS)).alias("_place"))
            .groupBy("_bucket")
            .agg(F.expr("bitmap_construct_agg(_place)").alias("_bits"))
        )

    def _place(self, *columns: str | Column) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.bits))

    def mark(self, rows: DataFrame, columns: list[str], name: str) -> DataFrame:
        """`rows` with a boolean column `name`: false where the key is not among the keys."""
        place = self._place(*columns)
        at = F.pmod(place, F.lit(BUCKET_BITS))
        byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.floor(F.coalesce(byte, F.lit(0)) / F.pow(F.lit(2.0), F.pmod(at, F.lit(8)))) % 2 == 1
        marked = rows.withColumn("_bucket", F.floor(place / BUCKET_BITS).cast("int")).join(F.broadcast(self.maps), "_bucket", "left")
        return marked.withColumn(name, bit).drop("_bucket", "_bits")
