"""JSON-stat 2.0 hypercubes as rows, parsed with built-in JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.tables import in_blocks, join_counted, written


def read_jsonstat(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, key map, value) of every file under `path`; one file is one task until its
    cells are dealt out anew. For files too large for that see read_cells()."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("json"))
    return parse_jsonstat(files)


#: The start of a document's values (a quote within a text is escaped), and what ends them.
START, END = r'(?<!\\)"value"\s*:\s*[\[{]', r"[\]}]"


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, key map, value) as of read_jsonstat(), of files of any size.

    Files are read as the texts between commas, which Spark splits by bytes, so that a file is as many
    tasks as it has splits. Texts are numbered by their place in a split plus the texts in the splits
    before; the longest run of texts from `"value": [` or `{` to its end holds the values, numbered
    within it, and what is left is the document without values, which is taken to be small (of a
    document with a status for each cell it is not). Files without values give no rows. `doc_id` is
    the file's name, or what its folder doc_id=... says; two files of one name are two documents.
    """
    texts = spark.read.option("lineSep", ",").text(path)
    name = F.col("doc_id").cast("string") if "doc_id" in texts.columns else F.col("_metadata.file_name")
    texts = texts.select(
        F.col("_metadata.file_path").alias("_file"), name.alias("_name"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_line"), F.col("value").alias("_text"),
    )
    texts = written(texts, "texts")
    splits = texts.groupBy("_file", "_split").agg(F.min("_line").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_file").orderBy("_split")) - F.col("_n")
    placed = texts.join(splits.select("_file", "_split", (before - F.col("_first")).alias("_shift")), ["_file", "_split"])
    # the part of a text from the start of the values on, or all of it
    starts = F.col("_text").rlike(START)
    placed = placed.select("_file", "_name", (F.col("_line") + F.col("_shift")).alias("_at"), "_text", starts.alias("_starts"), F.when(starts, F.regexp_extract("_text", f"(?s)^.*?{START}(.*)$", 1)).otherwise(F.col("_text")).alias("_rest"))
    placed = written(placed, "placed")
    ends = placed.where(F.col("_rest").rlike(END)).select("_file", F.col("_at").alias("_end"))
    runs = placed.where("_starts").select("_file", F.col("_at").alias("_start")).join(ends, "_file").where("_end >= _start").groupBy("_file", "_start").agg(F.min("_end").alias("_end"))
    longest = runs.groupBy("_file").agg(F.max(F.struct((F.col("_end") - F.col("_start")).alias("n"), (-F.col("_start")).alias("s"), "_start", "_end")).alias("_run"))
    sizes = written(placed.groupBy("_file").agg(F.count("*").alias("_n")).join(longest, "_file").select("_file", "_n", "_run._start", "_run._end"), "runs")
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    dealt = written(join_counted(placed, sizes, ["_file"], "_n", total, F.struct("_at")).where("_start is not null"), "dealt")

    inside = dealt.where("_at between _start and _end").withColumn("_cell", F.regexp_extract("_rest", r"(?s)^([^\]}]*)", 1))
    named = r'(?s)^\s*"(\d+)"\s*:(.*)$'
    sparse = F.col("_cell").rlike(named)
    flat = F.when(sparse, F.regexp_extract("_cell", named, 1).try_cast("long")).otherwise(F.col("_at") - F.col("_start"))
    value = F.trim(F.when(sparse, F.regexp_extract("_cell", named, 2)).otherwise(F.col("_cell")), F.lit(" \t\r\n")).try_cast("double")
    cells = inside.select("_file", flat.alias("flat"), value.alias("value")).where("value is not null")
    chunks = written(cells.groupBy("_file", F.floor(F.col("flat") / CHUNK).alias("_part")).agg(F.collect_list(F.struct("flat", "value")).alias("_cells")), "chunks")

    at_start, at_end = F.col("_at") == F.col("_start"), F.col("_at") == F.col("_end")
    head, tail = F.regexp_extract("_text", f"(?s)^(.*?{START})", 1), F.regexp_extract("_rest", rf"(?s)^[^\]}}]*({END}.*)$", 1)
    kept = F.when(at_start & at_end, F.concat(head, tail)).when(at_start, head).when(at_end, tail).otherwise(F.col("_text"))
    comma = F.when((F.col("_at") == 0) | (at_end & ~at_start), "").otherwise(",")
    outside = dealt.where("_at <= _start or _at >= _end").groupBy("_file", "_name").agg(F.array_sort(F.collect_list(F.struct("_at", F.concat(comma, kept).alias("t")))).alias("_t"))
    docs = outside.select(F.col("_file").alias("doc_id"), "_name", F.array_join(F.transform("_t", lambda x: x["t"]), "").alias("json"))
    parts = chunks.groupBy("_file").agg(F.count("*").alias("_n"))
    headers = written(_headers(docs, "_name").withColumnRenamed("doc_id", "_file").drop("_value").join(parts, "_file"), "headers")
    n_chunks = headers.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    whole = join_counted(chunks, headers, ["_file"], "_n", n_chunks, F.struct("_part"))
    return whole.select(F.col("_name").alias("doc_id"), F.inline(_keyed(F.col("_cells"))))


def category_codes(index: Column) -> Column:
    """Codes in order, from an array of codes or an object code -> position."""
    listed = F.from_json(index, "array<string>")
    placed = F.from_json(index, "map<string,int>")
    ordered = F.transform(F.array_sort(F.transform(F.map_entries(placed), lambda e: F.struct(e["value"].alias("at"), e["key"].alias("code")))), lambda e: e["code"])
    return F.when(F.startswith(F.trim(index), F.lit("[")), listed).otherwise(ordered)


#: Cells that are dealt out together, with the codes of their document.
CHUNK = 4096


def _headers(docs: DataFrame, *carry: str) -> DataFrame:
    """The dimensions of each document, their codes and strides, and its values as text."""
    top = F.from_json("json", "id array<string>, size array<int>, dimension string, value string")
    rows = docs.select("doc_id", *carry, top.alias("_t"))
    inner = F.from_json("_t.dimension", "id array<string>, size array<int>")
    rows = rows.select(
        "doc_id", *carry, F.coalesce("_t.id", inner["id"]).alias("_id"), F.coalesce("_t.size", inner["size"]).alias("_size"),
        F.from_json("_t.dimension", "map<string,string>").alias("_dims"), F.trim("_t.value").alias("_value"),
    )
    index = lambda d: F.from_json(F.try_element_at("_dims", d), "category struct<index string>")["category"]["index"]
    codes = F.transform("_id", lambda d: category_codes(index(d)))
    stride = F.transform("_id", lambda d, i: F.aggregate(F.slice("_size", i + 2, F.size("_size")), F.lit(1).cast("long"), lambda a, s: a * s))
    return rows.select("doc_id", *carry, "_id", "_size", codes.alias("_codes"), stride.alias("_stride"), "_value")


def _place(flat: Column, i: Column) -> Column:
    """The position in dimension i of the cell at a flat position; the last dimension varies fastest."""
    return (F.floor(flat / F.get("_stride", i)) % F.get("_size", i)).cast("int")


CELLS = "array<struct<flat:bigint,value:double>>"


def _values() -> Column:
    """A document's values, parsed: (dense array, sparse entries), one of them null."""
    entries = F.transform(F.map_entries(F.from_json("_value", "map<string,double>")), lambda e: F.struct(e["key"].cast("long").alias("flat"), e["value"].alias("value")))
    return F.struct(F.when(F.startswith("_value", F.lit("[")), F.from_json("_value", "array<double>")).alias("dense"), F.when(F.startswith("_value", F.lit("{")), entries).alias("sparse"))


def _cells(v: Column, pins: Column | None = None) -> Column:
    """The cells that have a value, at the pinned codes if there are pins (a map dimension -> code).

    Pins give the flat positions by stride arithmetic, so that of a dense array just those are
    read; of sparse entries those whose position fits stay. A pin on a dimension or code that the
    document lacks leaves nothing.
    """
    none = F.array().cast(CELLS)
    if pins is None:
        dense = F.transform(v["dense"], lambda x, i: F.struct(i.cast("long").alias("flat"), x.alias("value")))
        found = F.coalesce(dense, v["sparse"], none)
    else:
        pin = lambda d, i: (F.array_position(F.get("_codes", i), F.try_element_at(pins, d)) - 1).cast("int")
        pinned = F.transform("_id", lambda d, i: F.when(F.array_contains(F.map_keys(pins), d), F.coalesce(pin(d, i), F.lit(-1))))  # null: any
        steps = F.transform("_id", lambda d, i: F.when(F.get(pinned, i).isNull(), F.sequence(F.lit(0), F.get("_size", i) - 1)).otherwise(F.array(F.get(pinned, i))))
        scaled = F.transform(steps, lambda s, i: F.transform(s, lambda p: p * F.get("_stride", i)))
        flats = F.aggregate(scaled, F.array(F.lit(0).cast("long")), lambda a, s: F.flatten(F.transform(a, lambda x: F.transform(s, lambda y: x + y))))
        dense = F.transform(flats, lambda f: F.struct(f.alias("flat"), F.get(v["dense"], f.cast("int")).alias("value")))
        at = F.filter(F.transform("_id", lambda d, i: F.struct(F.get("_stride", i).alias("stride"), F.get("_size", i).alias("size"), F.get(pinned, i).alias("pos"))), lambda p: p["pos"].isNotNull())
        fits = lambda c, ps: F.forall(ps, lambda p: F.floor(c["flat"] / p["stride"]) % p["size"] == p["pos"])
        sparse = F.transform(F.array(at), lambda ps: F.filter(v["sparse"], lambda c: fits(c, ps)))[0]  # the pins are looked up once
        known = F.forall(F.map_keys(pins), lambda d: F.array_contains("_id", d)) & ~F.exists(pinned, lambda p: F.coalesce(p < 0, F.lit(False)))
        found = F.when(known, F.when(v["dense"].isNotNull(), dense).otherwise(sparse))
    return F.coalesce(F.filter(found, lambda c: c["value"].isNotNull()), none)


def _keyed(cells: Column) -> Column:
    key = lambda c: F.map_from_arrays("_id", F.transform("_id", lambda d, i: F.get(F.get("_codes", i), _place(c["flat"], i))))
    return F.transform(cells, lambda c: F.struct(key(c).alias("key"), c["value"].alias("value")))


def parse_jsonstat(docs: DataFrame, pins: dict[str, str] | None = None) -> DataFrame:
    """docs(doc_id, json) -> (doc_id, key, value), a row for each value that is not null.

    The last dimension varies fastest. `id` and `size` stand at the top or in `dimension`. With
    `pins`, only the cells at those codes are made, where the document is read, and nothing is
    shuffled. Without, chunks of cells are dealt out, so that a document is one task no longer.
    """
    once = lambda f: F.transform(F.array(_values()), f)[0]  # noqa: E731, a lambda's variable is computed before its body
    rows = _headers(docs)
    header = ["doc_id", "_id", "_size", "_codes", "_stride"]
    if pins:
        wanted = F.create_map(*[F.lit(x) for kv in pins.items() for x in kv])
        rows = rows.select(*header, once(lambda v: _cells(v, wanted)).alias("_cells"))
    else:
        size = F.lit(CHUNK)
        cut = lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(c), F.lit(1)) - 1) / CHUNK).cast("int")), lambda k: F.slice(c, k * size + 1, size))
        chunks = once(lambda v: F.transform(F.array(_cells(v)), cut)[0])
        rows = rows.select(*header, F.posexplode(chunks).alias("_part", "_cells")).repartition("doc_id", "_part")
    return rows.select("doc_id", F.inline(_keyed(F.col("_cells"))))


def parse_pinned(docs: DataFrame, metrics: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Cells of several metrics of each document: docs(dataset, json); metrics(dataset, filter map, more..)
    -> (dataset, more.., key, value). A document is read and parsed once, whatever the number of its
    metrics (a small table); each makes just its own cells, and none is shuffled."""
    more = [c for c in metrics.columns if c not in (dataset, "filter")]
    listed = metrics.groupBy(dataset).agg(F.collect_list(F.struct("filter", F.struct(*more).alias("m"))).alias("_metrics"))
    rows = _headers(docs.join(listed, dataset).withColumnRenamed(dataset, "doc_id"), "_metrics")
    made = lambda v: F.transform("_metrics", lambda m: F.struct(m["m"].alias("m"), _cells(v, m["filter"]).alias("cells")))
    rows = rows.select("doc_id", "_id", "_size", "_codes", "_stride", F.inline(F.transform(F.array(_values()), made)[0]))
    return rows.select(F.col("doc_id").alias(dataset), "m", F.inline(_keyed(F.col("cells")))).select(dataset, "m.*", "key", "value")


def category_labels(docs: DataFrame) -> DataFrame:
    """(doc_id, dim, code, pos, label) of every category of every document."""
    dims = docs.select("doc_id", F.from_json("json", "dimension string")["dimension"].alias("_d")).select("doc_id", F.explode(F.from_json("_d", "map<string,string>")).alias("dim", "_c"))
    parsed = dims.select("doc_id", "dim", F.from_json("_c", "category struct<index string, label map<string,string>>")["category"].alias("_c"))
    rows = parsed.select("doc_id", "dim", F.posexplode(category_codes(F.col("_c.index"))).alias("pos", "code"), F.col("_c.label").alias("_l"))
    return rows.select("doc_id", "dim", "code", "pos", F.try_element_at("_l", F.col("code")).alias("label"))


def to_jsonstat(cells: DataFrame, by: list[str], dims: list[str], split: str | None = None, most: int = 1000) -> DataFrame:
    """cells(by.., dims.., value) -> (by.., json): sparse documents, one for each `by`.

    With `split`, a dimension, some `most` of its codes go to a document, so that a `by` with
    many gives many documents of a bounded size; each lists all codes of the other dimensions,
    which are taken to be few.
    """
    cells = cells.withColumn("_block", F.lit(0).cast("long")) if split is None else in_blocks(cells, by, split, most)
    doc_key = [*by, "_block"]
    text = lambda d: F.col(d).cast("string").alias(d)
    rest = [d for d in dims if d != split]
    # the cells of a code of the split dimension go together, so that its position is its place in the list
    own = F.lit("").alias("_code") if split is None else F.col(split).cast("string").alias("_code")
    each = cells.groupBy(*doc_key, own).agg(F.collect_list(F.struct(*[text(d) for d in rest], "value")).alias("_cells"))
    found = each.groupBy(*doc_key).agg(F.sort_array(F.collect_list(F.struct("_code", "_cells"))).alias("_codes"))
    if rest:
        found = found.join(cells.groupBy(*(doc_key if split is None else by)).agg(*[F.array_sort(F.collect_set(text(d))).alias(f"_c_{d}") for d in rest]), doc_key if split is None else by)
    if split is not None:
        found = found.withColumn(f"_c_{split}", F.transform("_codes", lambda x: x["_code"]))

    def flat(c: Column, k: Column) -> Column:
        at = F.lit(0).cast("long")
        for d in dims:
            at = at * F.size(f"_c_{d}") + (k if d == split else F.array_position(f"_c_{d}", c[d]) - 1)
        return at.cast("string")

    of_code = lambda x, k: F.transform(x["_cells"], lambda c: F.struct(flat(c, k).alias("flat"), c["value"].alias("value")))
    values = F.map_from_entries(F.flatten(F.transform("_codes", of_code)))
    place = lambda d: F.map_from_arrays(F.col(f"_c_{d}"), F.sequence(F.lit(0), F.size(f"_c_{d}") - 1))
    dimension = F.struct(*[F.struct(F.struct(place(d).alias("index")).alias("category")).alias(d) for d in dims])
    doc = F.struct(F.array(*[F.lit(d) for d in dims]).alias("id"), F.array(*[F.size(f"_c_{d}") for d in dims]).alias("size"), dimension.alias("dimension"), values.alias("value"))
    return found.select(*by, F.to_json(doc).alias("json"))
