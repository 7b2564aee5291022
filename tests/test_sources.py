import json

import pytest

from tessella.operators import geo
from tessella.sources import datasets, geojson, jsonstat


def cells(spark, doc):
    found = jsonstat.parse_jsonstat(spark.createDataFrame([("d", json.dumps(doc))], "doc_id string, json string"))
    return sorted((tuple(sorted(r.key.items())), r.value) for r in found.collect())


def cube(value, index_b):
    return {"id": ["a", "b"], "size": [2, 2], "dimension": {"a": {"category": {"index": ["x", "y"], "label": {"x": "Ex"}}}, "b": {"category": {"index": index_b}}}, "value": value}


WANT = [((("a", "x"), ("b", "p")), 1.0), ((("a", "x"), ("b", "q")), 2.0), ((("a", "y"), ("b", "q")), 4.0)]


def test_dense_and_sparse_cubes(spark):
    assert cells(spark, cube([1, 2, None, 4], ["p", "q"])) == WANT
    assert cells(spark, cube({"0": 1, "1": 2, "3": 4}, {"q": 1, "p": 0})) == WANT


def test_id_and_size_in_the_dimension(spark):
    doc = cube([1, 2, None, 4], ["p", "q"])
    doc["dimension"] |= {"id": doc.pop("id"), "size": doc.pop("size")}
    assert cells(spark, doc) == WANT


def test_category_labels(spark):
    docs = spark.createDataFrame([("d", json.dumps(cube([1], ["p", "q"])))], "doc_id string, json string")
    found = sorted((r.dim, r.code, r.pos, r.label) for r in jsonstat.category_labels(docs).collect())
    assert found == [("a", "x", 0, "Ex"), ("a", "y", 1, None), ("b", "p", 0, None), ("b", "q", 1, None)]


def test_cubes_in_blocks_of_a_dimension(spark):
    rows = [(g, f"r{k}", y, float(k * 10 + y)) for g, n in (("big", 40), ("small", 2)) for k in range(n) for y in (1, 2) if k or y == 1]
    table = spark.createDataFrame(rows, "g string, region string, year int, value double")
    docs = jsonstat.to_jsonstat(table, ["g"], ["region", "year"], split="region", most=5)
    per = {r["g"]: r["count"] for r in docs.groupBy("g").count().collect()}
    assert 3 <= per["big"] <= 8 and per["small"] == 1
    found = jsonstat.parse_jsonstat(docs.withColumnRenamed("g", "doc_id")).collect()
    assert sorted((r.doc_id, r.key["region"], int(r.key["year"]), r.value) for r in found) == sorted(rows)
    # each document lists all codes of the other dimension
    years = jsonstat.category_labels(docs.withColumnRenamed("g", "doc_id")).where("dim = 'year'").select("doc_id", "code", "pos").distinct()
    assert sorted(map(tuple, years.collect())) == [(g, str(y), y - 1) for g in ("big", "small") for y in (1, 2)]
    none = jsonstat.to_jsonstat(table.limit(0), ["g"], ["region", "year"], split="region")
    assert none.count() == 0


def test_geojson(spark):
    square = [[[0, 0], [4, 0], [4, 4], [0, 4]], [[1, 1], [2, 1], [2, 2], [1, 2]]]
    two = [[[[0, 0], [1, 0], [1, 1]]], [[[5, 5], [6, 5], [6, 6], [5, 6]], [[0, 0], [1, 1]]]]
    doc = {
        "type": "FeatureCollection",
        "features": [
            {"properties": {"id": "s"}, "geometry": {"type": "Polygon", "coordinates": square}},
            {"properties": {"code": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": two}},
            {"properties": {"id": "p"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        ],
    }
    rings = geojson.parse_geojson(spark.createDataFrame([("g", json.dumps(doc))], "geo string, json string"), "id", "code")
    valid = geo.valid_rings(rings)
    assert sorted((r.region_id, r.poly_ord, r.ring_ord, len(r.xs)) for r in valid.collect()) == [("m", 0, 0, 3), ("m", 1, 0, 4), ("s", 0, 0, 4), ("s", 0, 1, 4)]
    again = geojson.parse_geojson(geojson.to_geojson(valid, "id"), "id")
    assert sorted(map(str, again.collect())) == sorted(map(str, valid.select(*again.columns).collect()))
    parts = geojson.to_geojson(valid, "id", most=1)
    apart = geojson.parse_geojson(parts, "id").drop("feature_ord")
    assert sorted(map(str, apart.collect())) == sorted(map(str, valid.select(*apart.columns).collect()))


def test_datasets_round_trip(spark, tmp_path):
    doc = {
        "regions": {"key": "id", "labels": {"a": "A"}, "colors": {"a": "#fff"}},
        "datasets": {"i": {"label": "I", "unit": "", "kind": "count", "source": "s", "sourceUrl": "u", "decimals": 0, "values": {"2000": {"a": 1.5}}}},
    }
    (tmp_path / "g-datasets.json").write_text(json.dumps(doc))
    indicator, panel, region = datasets.read_datasets(spark, str(tmp_path))
    assert [tuple(r) for r in panel.collect()] == [("g", "i", 2000, "a", 1.5)]
    assert [tuple(r) for r in region.collect()] == [("g", "a", "A", "#fff")]
    again = datasets.parse_datasets(datasets.datasets_json(panel, indicator, region))[1]
    assert again.collect() == panel.collect()
    datasets.write_datasets(panel, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_datasets_in_several_files(spark, tmp_path):
    rows = [("g", i, y, f"r{k}", float(k + y)) for i in ("a", "b") for y in (2000, 2001) for k in range(12) if k or y == 2000]
    rows.append(("h", "a", 2000, "r0", 1.0))
    panel = spark.createDataFrame(rows, "geo string, indicator string, year int, region_id string, value double")
    names = [("g", f"r{k}", f"Region {k}") for k in range(14)] + [("h", "r0", "Only")]  # two without values
    region = spark.createDataFrame(names, "geo string, region_id string, label string")
    kinds = [(g, i, i, "", "count", 0, "s", "u") for g in ("g", "h", "none") for i in ("a", "b")]
    indicator = spark.createDataFrame(kinds, "geo string, indicator string, label string, unit string, kind string, decimals int, source string, source_url string")
    files = datasets.datasets_json(panel, indicator, region, most=4)
    assert 2 <= files.where("geo = 'g'").count() <= 4 and files.where("geo <> 'g'").count() == 2
    datasets.write_files(files, str(tmp_path / "files"))
    found, values, labels = datasets.read_datasets(spark, str(tmp_path / "files"))
    assert sorted(map(tuple, values.collect())) == sorted(rows)
    assert sorted(tuple(r)[:3] for r in labels.collect()) == sorted(names)
    assert sorted((r.geo, r.indicator) for r in found.distinct().collect()) == sorted((k[0], k[1]) for k in kinds)


def test_meta_of_several_files_is_one_row(spark):
    docs = [("g", json.dumps({"meta": {"builtBy": "nightly"}, "datasets": {}})) for _ in range(3)] + [("g", '{"datasets":{}}'), ("h", json.dumps({"meta": {"builtBy": "hand"}})), ("none", "{}")]
    meta = datasets.parse_meta(spark.createDataFrame(docs, "geo string, json string")).collect()
    assert sorted(map(tuple, meta)) == [("g", {"builtBy": "nightly"}), ("h", {"builtBy": "hand"}), ("none", None)]


def test_curated_regions_in_several_files(spark, tmp_path):
    """A curated block is dealt out with its other fields, entries whole; values of regions it lacks stay."""
    curated = {"note": {"by": "hand", "n": 3}, "key": "code", "flag": "5", "labels": {f"r{k}": f'Name "{k}"' for k in range(30)}, "colors": {f"r{k}": "#00f" for k in range(0, 33, 3)}}
    old = [("g", json.dumps({"regions": curated, "datasets": {}})), ("bare", json.dumps({"datasets": {}}))]
    rows = [(g, "a", y, f"r{k}", float(k + y)) for g in ("g", "h", "bare") for y in (2000, 2001) for k in range(35)]
    panel = spark.createDataFrame(rows, "geo string, indicator string, year int, region_id string, value double")
    region = spark.createDataFrame([(g, f"r{k}", "made") for g in ("g", "h", "bare") for k in range(35)], "geo string, region_id string, label string")
    indicator = spark.createDataFrame([(g, "a", "A", "", "count", 0, "s", "u") for g in ("g", "h", "bare")], "geo string, indicator string, label string, unit string, kind string, decimals int, source string, source_url string")
    files = datasets.datasets_json(panel, indicator, region, spark.createDataFrame(old, "geo string, json string"), most=8)
    blocks = [json.loads(r.json)["regions"] for r in files.where("geo = 'g'").collect()]
    assert len(blocks) >= 3 and max(len(b.get("labels", {})) for b in blocks) < 30
    merged = {"labels": {}, "colors": {}}
    for b in blocks:
        if b:
            assert (b["note"], b["key"], b["flag"]) == (curated["note"], "code", "5")
            merged = {k: merged[k] | b[k] for k in merged}
    assert merged == {k: curated[k] for k in merged}
    datasets.write_files(files, str(tmp_path / "files"))
    _, values, labels = datasets.read_datasets(spark, str(tmp_path / "files"))
    assert sorted(map(tuple, values.collect())) == sorted(rows)
    made = {(r.geo, r.region_id, r.label) for r in labels.where("geo <> 'g'").collect()}
    assert made == {(g, f"r{k}", "made") for g in ("h", "bare") for k in range(35)}
    # again, over the files just written
    twice = datasets.datasets_json(panel, indicator, region, datasets.read_files(spark, str(tmp_path / "files")), most=5)
    again = datasets.parse_datasets(twice)[2]
    assert sorted(map(str, again.where("geo = 'g'").collect())) == sorted(map(str, labels.where("geo = 'g'").collect()))


def _cube(n_geo, dense, gap=7):
    """A cube of 2 indicators x n_geo places x 4 years; every gap-th value is missing."""
    places = [f"g{k}" for k in range(n_geo)]
    values = [None if k % gap == 0 else k / 2 for k in range(2 * n_geo * 4)]
    dims = {"indicator": ["a", "b"], "geo": places, "time": ["2000", "2001", "2002", "2003"]}
    doc = {
        "id": list(dims), "size": [len(x) for x in dims.values()], "value": values if dense else {str(k): v for k, v in enumerate(values) if v is not None},
        "dimension": {d: {"category": {"index": {c: i for i, c in enumerate(x)}}} for d, x in dims.items()},
    }
    cells = {(i, g, t): values[(x * n_geo + y) * 4 + z] for x, i in enumerate("ab") for y, g in enumerate(places) for z, t in enumerate(dims["time"])}
    return json.dumps(doc), {k: v for k, v in cells.items() if v is not None}


def _found(df):
    rows = [(tuple(r.key[d] for d in ("indicator", "geo", "time")), r.value) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("split", [97, 1 << 20])
def test_cells_of_files_in_splits(spark, tmp_path, split):
    """The same rows as of whole files, wherever a file is cut; a dense file is read by several tasks."""
    for name, n, dense in (("a", 10, True), ("b", 10, False), ("c", 1, True)):
        (tmp_path / f"{name}.json").write_text(_cube(n, dense)[0])
    # values first or last, spread over lines, another array of that name, a text that looks like one, one cell or none
    doc = json.loads(_cube(9, True, 5)[0])
    note = {"label": 'is "value":[1,2,3,4,5,6,7,8,9', "extension": {"value": [7, 8]}}
    (tmp_path / "first.json").write_text(json.dumps({"value": doc.pop("value"), **note, **doc}, indent=1))
    one = {"id": ["d"], "size": [1], "dimension": {"d": {"category": {"index": ["x"]}}}}
    (tmp_path / "one.json").write_text(json.dumps(one | {"value": [1.5e3]}))
    (tmp_path / "none.json").write_text(json.dumps(one | {"value": []}))
    (tmp_path / "lacks.json").write_text(json.dumps(one))
    want = sorted((r.doc_id, sorted(r.key.items()), r.value) for r in jsonstat.read_jsonstat(spark, str(tmp_path)).collect())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        tasks = spark.read.option("lineSep", ",").text(str(tmp_path / "a.json")).rdd.getNumPartitions()
        rows = jsonstat.read_cells(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.doc_id, sorted(r.key.items()), r.value) for r in rows.collect()) == want
    assert len({d for d, *_ in want}) == 5 and (split > 1000 or tasks > 1)


def test_pins_make_only_their_cells(spark):
    for dense in (True, False):
        text, cells = _cube(50, dense)
        docs = spark.createDataFrame([("d", text)], "doc_id string, json string")
        assert _found(jsonstat.parse_jsonstat(docs)) == cells
        for pins in ({"indicator": "b"}, {"time": "2002", "indicator": "a"}, {"geo": "g7"}, {"geo": "g7", "time": "2000", "indicator": "b"}):
            found = jsonstat.parse_jsonstat(docs, pins)
            want = {k: v for k, v in cells.items() if all(dict(zip(("indicator", "geo", "time"), k))[d] == c for d, c in pins.items())}
            assert _found(found) == want
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        for pins in ({"indicator": "c"}, {"sex": "T"}):
            assert jsonstat.parse_jsonstat(docs, pins).count() == 0


def test_metrics_of_one_document(spark):
    text, cells = _cube(20, True)
    docs = spark.createDataFrame([("d", text), ("e", text)], "dataset string, json string")
    rows = [("d", {"indicator": "a"}, "A"), ("d", {"indicator": "b", "time": "2001"}, "B"), ("x", {"indicator": "a"}, "C")]
    found = jsonstat.parse_pinned(docs, spark.createDataFrame(rows, "dataset string, filter map<string,string>, name string"))
    got = {(r.name, r.key["geo"], r.key["time"]): r.value for r in found.collect()}
    want = {("A", g, t): v for (i, g, t), v in cells.items() if i == "a"} | {("B", g, t): v for (i, g, t), v in cells.items() if i == "b" and t == "2001"}
    assert got == want and found.count() == len(want)


def test_cells_are_dealt_out_in_chunks(spark):
    """What is shuffled of a document is its chunks of cells, each with the codes once."""
    text, cells = _cube(1250, True)
    docs = spark.createDataFrame([("d", text)], "doc_id string, json string")
    found = jsonstat.parse_jsonstat(docs)
    assert _found(found) == cells
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan.index("RepartitionByExpression")
    assert "inline" in plan[:dealt] and "posexplode" in plan[dealt:]
