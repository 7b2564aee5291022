"""Tables in the folder that driver and executors share, joins with groups of any size, and
what Python workers import."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where a session names none (a local test) a temporary folder is set instead.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, read again from a table in the shared folder: lineage ends there,
    and an executor lost later costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did, as where it is not
    installed but lies in a folder that all have."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def by_merge(df: DataFrame) -> DataFrame:
    """Rows whose join shuffles and merges both sides. Spark broadcasts a side by the size of the file it is read
    from, and a packed file of a few MB holds millions of cells, which the driver would have to gather."""
    return df.hint("merge")


def join_counted(
    left: DataFrame, groups: DataFrame, on: list[str], size: str, total: int, spread: Column, least: int = 1000, groups_at_most: int = 4096
) -> DataFrame:
    """Left join of rows with one row per group, where a group may hold a third of all rows.

    `groups[size]` is the number of `left` rows of the group. Groups of at least
    max(least, total / groups_at_most) rows are broadcast: there can be no more than
    `groups_at_most` of them, whatever the data. Their rows take no part in the shuffled
    join of the rest: a salt from `spread` deals them over all partitions.
    """
    bar = max(least, total // groups_at_most)
    values = [c for c in groups.columns if c not in on]
    hot = groups.where(F.col(size) >= bar).select(*on, *[F.col(c).alias(f"_hot_{c}") for c in values])
    # 0 in every row, but not as a literal: the optimizer would take that out of the join keys
    rest = groups.where(F.col(size) < bar).withColumn("_salt", F.pmod(F.xxhash64(size), F.lit(1)).cast("int"))
    out = left.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.when(F.col(f"_hot_{size}").isNull(), 0).otherwise((1 + F.pmod(F.xxhash64(spread), F.lit(1009))).cast("int"))
    )
    out = out.join(rest, [*on, "_salt"], "left")
    return out.select(*left.columns, *[F.coalesce(f"_hot_{c}", c).alias(c) for c in values])


def in_blocks(rows: DataFrame, by: list[str], column: str, most: int) -> DataFrame:
    """Adds _block: within `by`, some `most` values of `column` are in a block, and all rows of
    a value in the same one. The number of blocks follows from the number of values."""
    sizes = rows.groupBy(*by).agg(F.count_distinct(column).alias("_values"), F.count("*").alias("_in"))
    dealt = join_counted(rows, sizes, by, "_in", rows.count(), F.struct(column))
    block = F.pmod(F.xxhash64(column), F.greatest(F.ceil(F.col("_values") / most), F.lit(1)))
    return dealt.select(*rows.columns, F.coalesce(block, F.lit(0)).alias("_block"))
