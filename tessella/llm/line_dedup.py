"""Line deduplication by the passages that texts share, in DataFrame functions only.

A passage is two lines that follow each other, at least one of them not blank, or one line of
LONG_WORDS words. A longer passage is cut at each line, so that it is a chain of such pairs,
found whole from its first line to its last wherever it stands; a cut at fewer lines would
leave what stands between a passage's edge and the first cut in it. Lines of passages that
came before anywhere are removed: candidates come from 64-bit hashes, and the SHA-256 of
their bytes decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashFilter, join_counted, table, text_or_empty, written

#: A line alone is a passage if it has so many words (spaces between them, less one).
LONG_WORDS = 50


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256)).alias("digest")


def _passages(lines: Column, with_digest: bool) -> Column:
    """Array of (start, end, hash, size) of the passages, in lines from 0, end exclusive;
    and the SHA-256 of their bytes."""

    def described(line: Column) -> Column:
        spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
        return F.struct(F.xxhash64(line).alias("h"), F.octet_length(line).alias("size"), (F.trim(line) == "").alias("blank"), (spaces >= LONG_WORDS - 1).alias("long"))

    def found(v: Column) -> Column:
        def pair(x: Column, k: Column) -> Column:
            y = F.get(v, k + 1)
            fields = [k.alias("start"), (k + 2).alias("end"), F.xxhash64(x["h"], y["h"]).alias("hash"), (x["size"] + y["size"] + 1).alias("size")]
            both = F.concat(F.get(lines, k), F.lit("\n"), F.get(lines, k + 1))
            return F.when(~(x["blank"] & y["blank"]), F.struct(*fields, *([_digest(both)] if with_digest else [])))

        def alone(x: Column, k: Column) -> Column:
            fields = [k.alias("start"), (k + 1).alias("end"), F.xxhash64(x["h"]).alias("hash"), x["size"].alias("size")]
            return F.when(x["long"], F.struct(*fields, *([_digest(F.get(lines, k))] if with_digest else [])))

        return F.array_compact(F.concat(F.transform(v, pair), F.transform(v, alone)))

    # the descriptions are computed once: a lambda's variable is computed before its body
    return F.transform(F.array(F.transform(lines, described)), found)[0]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds clean_text, n_lines, n_removed (lines) and n_chunks_removed to each row.

    Lines are separated by a newline. A line is removed if it lies in a passage (see above)
    that came before: of equal passages (their bytes) the one is first that comes first by id,
    a null id before all, and then by place in the text; of rows that repeat id and text,
    which are told apart by nothing, each is treated as the others are. Each removed line is
    left in some place before. n_chunks_removed counts the runs of removed lines. What stays
    is joined by newlines. A null or empty text is one empty line and stays
    as an empty text. Should passages with different bytes share a hash, they all stay. `carry`
    (default: all) names the columns kept besides; ones named like the new ones are replaced.
    An empty table gives no rows; texts of any length are cut whole.
    """
    new = ["clean_text", "n_lines", "n_removed", "n_chunks_removed"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in new]
    id_, text = F.col(id_col), text_or_empty(text_col)
    rows = docs.select(F.struct(*carry).alias("_row"), id_.alias("_id"), F.xxhash64(text).alias("_text_hash"), text.alias("_text"))
    lined = rows.select("_id", "_text_hash", F.split("_text", "\n", -1).alias("_lines"))

    def passages(with_digest: bool) -> DataFrame:
        out = lined.select("_id", "_text_hash", F.explode(_passages(F.col("_lines"), with_digest)).alias("_p"))
        digest = [F.col("_p.digest").alias("_digest")] if with_digest else []
        return out.select("_id", "_text_hash", "_p.start", "_p.end", F.col("_p.hash").alias("_hash"), F.col("_p.size").alias("_size"), *digest)

    key = ["_hash", "_size"]
    # each is read several times
    repeated = written(passages(False).groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*key), "repeated")
    maybe = written(HashFilter(repeated, key).mark(passages(True), key, "_maybe").where("_maybe").drop("_maybe"), "passages")
    # rows are gathered by the passage's digest; a hash with two digests is left alone
    order = F.when(F.col("_id").isNull(), 0).otherwise(1)
    by_bytes = maybe.groupBy(*key, "_digest").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"), F.min(order).alias("_some"))
    groups = by_bytes.groupBy(*key).agg(F.count("*").alias("_texts"), F.sum("_n").alias("_n"), F.max("_first").alias("_first"), F.max("_some").alias("_some"))
    groups = groups.where("_texts = 1 and _n > 1").select(*key, "_n", F.when(F.col("_some") == 1, F.col("_first")).alias("_first"))
    light = maybe.select("_id", "_text_hash", "start", "end", *key)
    total = light.count()
    known = join_counted(light, groups, key, "_n", total, F.struct("_id", "start")).where("_n is not null")
    first = ["_id", "_text_hash"]
    # per text: the passages that another text has first, or that the same id has before
    own = F.col("_id").eqNullSafe(F.col("_first")).alias("_own")
    places = known.groupBy(*first, *key, own).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_places"), F.count("*").alias("_rows"))
    late = places.select(*first, F.when(F.col("_own"), F.slice("_places", 2, F.size("_places"))).otherwise(F.col("_places")).alias("_late"), (F.col("_rows") / F.size("_places")).cast("long").alias("_copies"))
    found = late.where(F.size("_late") > 0).groupBy(*first).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_late")))).alias("_found"), F.max("_copies").alias("_copies"))

    # both starts and ends ascend: a run ends where the next passage does not touch it
    def run_starts(f: Column) -> Column:
        return F.filter(f, lambda c, k: (k == 0) | (c["start"] > F.get(f, k - 1)["end"]))

    def run_ends(f: Column) -> Column:
        return F.filter(f, lambda c, k: (k == F.size(f) - 1) | (F.get(f, k + 1)["start"] > c["end"]))

    runs = F.zip_with(run_starts(F.col("_found")), run_ends(F.col("_found")), lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))
    removed = written(found.select(*first, "_copies", runs.alias("_removed")), "removed")
    marked = HashFilter(removed, first).mark(rows, first, "_maybe")
    none = F.array().cast("array<struct<start:int,end:int>>")
    untouched = marked.where("not _maybe").select("_row", "_text", none.alias("_removed"))
    # a third of the rows may share text and id. Of `total` passages each copy holds those of its runs,
    # so that the runs of all texts that are broadcast are no more than 4096
    text_and_id = F.concat_ws(" ", F.hex("_text_hash"), F.col("_id").cast("string")).alias("_key")  # a null id is one too
    removed = removed.select(text_and_id, "_copies", "_removed")
    touched = join_counted(marked.where("_maybe").select("_row", "_text", text_and_id), removed, ["_key"], "_copies", total, F.monotonically_increasing_id())
    touched = touched.select("_row", "_text", F.coalesce("_removed", none).alias("_removed"))
    out = untouched.unionByName(touched).withColumn("_lines", F.split("_text", "\n", -1))
    # what stays lies between the removed runs
    before = F.transform("_removed", lambda c, k: F.struct(F.coalesce(F.get("_removed", k - 1)["end"], F.lit(0)).alias("at"), c["start"].alias("to")))
    after = F.array(F.struct(F.coalesce(F.try_element_at("_removed", F.lit(-1))["end"], F.lit(0)).alias("at"), F.size("_lines").alias("to")))
    kept = F.flatten(F.transform(F.concat(before, after), lambda c: F.slice(F.col("_lines"), c["at"] + 1, c["to"] - c["at"])))
    lost = F.aggregate("_removed", F.lit(0), lambda acc, c: acc + c["end"] - c["start"])
    out = out.select(  # before the carried columns, which may have any names
        "_row",
        F.when(F.size("_removed") == 0, F.col("_text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"),
        F.size("_lines").cast("long").alias("n_lines"),
        lost.cast("long").alias("n_removed"),
        F.size("_removed").cast("long").alias("n_chunks_removed"),
    )
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in carry], *new)


def op8_line_dedup(spark, sf_dir):
    found = dedup_lines(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("doc_id", "n_lines", "n_removed", "n_chunks_removed", F.length("clean_text").cast("long").alias("clean_chars"), F.sha2("clean_text", 256).alias("clean_sha256"))
