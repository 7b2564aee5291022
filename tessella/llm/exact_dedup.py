"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashFilter, join_counted, table, text_or_empty, written

PREFIX_CHARS = 256


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds to each row: keep_id, group_size, kept.

    Texts are equal when they are identical; a null text counts as empty. Of equal texts the
    row with the largest id stays; a null id is smaller than any other. Of rows that repeat
    both id and text one is kept. An empty table gives no rows; texts of any length are
    compared whole. keep_id is null if all ids of a group are null. `carry` names the columns that the result
    has besides (default: all); input columns named like the new ones are replaced.

    1. rows are counted by length and prefix hash; a group of one row is decided;
    2. only rows whose (length, prefix) group may have more than one row get a SHA-256 of
       the full text: the groups are looked up in a bit set of bounded size, so that no
       text is shuffled;
    3. those are grouped by (length, prefix hash, full hash). The join back to the rows
       broadcasts the few largest groups (join_counted).
    """
    new = ["keep_id", "group_size", "kept"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in new]
    text = text_or_empty(text_col)
    rows = docs.select(
        F.struct(*carry).alias("_row") if carry else F.lit(None).alias("_row"),
        F.col(id_col).alias("_id"),
        text.alias("_text"),
        F.octet_length(text).alias("_len"),
        F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("_pre"),
    )
    by_length = rows.groupBy("_len", "_pre").agg(F.count("*").alias("_n"))
    survivors = HashFilter(written(by_length.where("_n > 1"), "lengths"), ["_len", "_pre"])
    hashed = survivors.mark(rows, ["_len", "_pre"], "_maybe").select(
        "_row", "_id", "_len", "_pre", F.when(F.col("_maybe"), F.sha2("_text", 256)).alias("_full")
    )
    members = hashed.where("_full is not null")
    per_id = members.groupBy("_len", "_pre", "_full", "_id").agg(F.count("*").alias("_rows"))
    groups = per_id.groupBy("_len", "_pre", "_full").agg(
        F.max("_id").alias("_keep"), F.sum("_rows").alias("_size"), F.max("_rows").alias("_most")
    ).where("_size > 1")
    groups = written(groups, "groups")
    total = docs.count()
    out = join_counted(hashed.withColumn("_full", F.coalesce("_full", F.lit(""))), groups, ["_len", "_pre", "_full"], "_size", total, F.struct("_id"))
    out = out.withColumn("_keep", F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep")))
    out = out.withColumn("_size", F.coalesce("_size", F.lit(1)).cast("long"))
    last = F.col("_id").eqNullSafe(F.col("_keep"))
    alone = out.where("coalesce(_most, 1) = 1").withColumn("_kept", last)
    if groups.where("_most > 1").head(1):
        # rows that repeat id and text, however many: one of each group by a number of its own
        repeats = written(out.where("_most > 1").withColumn("_at", F.monotonically_increasing_id()), "repeats")
        first = repeats.where(last).groupBy("_len", "_pre", "_full").agg(F.min("_at").alias("_first")).select("_first")
        repeats = repeats.join(first, F.col("_at") == F.col("_first"), "left").withColumn("_kept", F.col("_first").isNotNull())
        alone = alone.unionByName(repeats.drop("_at", "_first"))
    out = alone
    return out.select(
        *[F.col(f"_row.{c}").alias(c) for c in carry],
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"),
    )


def op7_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.sha2(text_or_empty("text"), 256).alias("text_sha256"))
    return exact_groups(docs, carry=["doc_id", "text_sha256"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def exact_dedup_stage(spark, docs, sf_dir):
    """Pipeline stage: of each group of equal texts the row with the largest id stays, a null text
    counting as empty and a null id as smaller than any other; of rows that repeat id and text one. An
    empty table gives no rows. Rows whose length and prefix are alone go on as they are: only
    those that may have copies are shuffled, one a task and group."""
    text = text_or_empty("text")
    rows = docs.select(
        F.struct(*docs.columns).alias("_doc"), text.alias("_text"), F.octet_length(text).alias("_len"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("_pre")
    )  # columns of docs may have any names
    by_length = rows.groupBy("_len", "_pre").agg(F.count("*").alias("_n"))
    marked = HashFilter(written(by_length.where("_n > 1"), "lengths"), ["_len", "_pre"]).mark(rows, ["_len", "_pre"], "_maybe")
    some = marked.where("_maybe").groupBy("_len", "_pre", F.sha2("_text", 256).alias("_full"))
    kept = some.agg(F.max_by("_doc", F.struct(F.col("_doc.doc_id").isNotNull(), F.col("_doc.doc_id"))).alias("_doc"))
    return marked.where("not _maybe").select("_doc").unionByName(kept.select("_doc")).select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
