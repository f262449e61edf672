"""One large JSON document read in many tasks."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake.operators import districts
from transitlake.sources import files, jsonsplit
from transitlake.sources.jsonsplit import json_records, numbered_over_files

CONF = {"spark.sql.files.maxPartitionBytes": "997", "spark.sql.files.openCostInBytes": "1"}


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


MARKS = ['"', "\\", "{", "}", "[", "]", ",", ":", " ", "é", "🎉", "\n", "a", '"features":[', "}]", "\\\""]


def value(rnd, depth=0):
    text = "".join(rnd.choice(MARKS) for _ in range(rnd.randint(0, 9)))
    kind = rnd.randint(0, 7 if depth < 3 else 3)
    if kind <= 1:
        return text
    if kind == 2:
        return rnd.choice([None, True, -1.5e-3, 7])
    if kind == 3:
        return []
    if kind <= 5:
        return [value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
    return {rnd.choice(["features", "type", text]): value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))}


def thing(rnd):
    return {"type": "Feature", "n": rnd.randint(0, 9)} | {f"k{i}": value(rnd) for i in range(rnd.randint(0, 4))}


@pytest.mark.parametrize("seed", range(6))
def test_random_documents(spark, tmp_path, small_splits, seed):
    rnd, want = random.Random(seed), []
    for name in "abcd":
        feats = [thing(rnd) for _ in range(rnd.choice([0, 1, 40]))]
        doc = {f"before{i}": value(rnd) for i in range(rnd.randint(0, 3))} | {"features": feats} | {f"after{i}": [thing(rnd), value(rnd)] for i in range(rnd.randint(0, 2))}
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=rnd.choice([None, 1, 4]), ensure_ascii=rnd.choice([True, False])) + rnd.choice(["", "\n"]), encoding="utf-8")
        want += [(name, i, f) for i, f in enumerate(feats)]
    got = numbered_over_files(json_records(spark, str(tmp_path), "features")).orderBy("idx").collect()
    assert [(r["file"][-6], r["at"], json.loads(r["json"])) for r in got] == want
    assert [r["idx"] for r in got] == list(range(len(want)))


def test_a_file_is_read_by_many_tasks_and_numbered_alike(spark, tmp_path):
    feats = [{"type": "Feature", "properties": {"l_qu": f"Q{i} }}", "c_ar": i}, "geometry": {"type": "Polygon", "coordinates": [[[i, 1], [2, 3]]]}} for i in range(300)]
    (tmp_path / "q.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}), encoding="utf-8")
    whole = [tuple(r) for r in districts.read_features(spark, str(tmp_path / "q.geojson")).orderBy("idx").collect()]
    old = {k: spark.conf.get(k) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    try:
        text = spark.read.option("lineSep", "}").text(str(tmp_path / "q.geojson"))
        assert text.select(F.spark_partition_id()).distinct().count() > 10
        split = [tuple(r) for r in districts.read_features(spark, str(tmp_path / "q.geojson")).orderBy("idx").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert split == whole and [r[1]["c_ar"] for r in split] == list(range(300)) and split[299][2]["coordinates"] == [[[299.0, 1.0], [2.0, 3.0]]]


def test_many_chunks_in_a_split(spark, tmp_path, monkeypatch):
    """Running totals go on from chunk to chunk, and no window holds more pieces than a chunk, however large the split."""
    monkeypatch.setattr(jsonsplit, "CHUNK", 7)
    feats = [thing(random.Random(i)) for i in range(200)]
    (tmp_path / "q.json").write_text(json.dumps({"a": "}", "features": feats, "z": [{}]}), encoding="utf-8")
    pieces = jsonsplit._pieces(spark, str(tmp_path))
    assert pieces.select("block").distinct().count() == 1
    assert pieces.groupBy(*jsonsplit._CHUNK).count().agg(F.max("count")).first()[0] == 7
    got = json_records(spark, str(tmp_path), "features").orderBy("at").collect()
    assert [json.loads(r["json"]) for r in got] == feats


def test_json_map_round_trip(spark, tmp_path, small_splits):
    value_type = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType()), T.StructField("s", T.StructType([T.StructField("x", T.DoubleType())]))])
    data = [(f'k"{i}\\}}', f'{{"v": [{i}]}} é', None if i % 5 == 0 else i, (i / 2,)) for i in range(60)]
    df = spark.createDataFrame(data, T.StructType([T.StructField("id", T.StringType()), *value_type.fields]))
    path = str(tmp_path / "m.json")
    files.write_json_map(df.repartition(7), path, "id")
    text = "".join((tmp_path / "m.json" / f).read_text(encoding="utf-8") for f in sorted(p.name for p in (tmp_path / "m.json").iterdir()) if f.startswith("part-"))
    assert json.loads(text) == {k: {"a": a, "b": b, "s": {"x": s[0]}} for k, a, b, s in data}  # one JSON object
    back = files.read_json_map(spark, path, value_type, "id")
    assert sorted(((r["id"], r["a"], r["b"], (r["s"]["x"],)) for r in back.collect()), key=str) == sorted(data, key=str)
    files.write_json_map(df.limit(0), str(tmp_path / "e.json"), "id")
    assert files.read_json_map(spark, str(tmp_path / "e.json"), value_type).count() == 0


def test_root_array_and_lines(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"features": [{"x": 1}, 5, {"w": []}]}', encoding="utf-8")
    with pytest.raises(Exception, match="no object"):
        json_records(spark, str(tmp_path / "b.json"), "features").collect()
    (tmp_path / "a.json").write_text('[{"x": 1}, {"y": {"z": 2}}, {"w": []}]', encoding="utf-8")
    assert [json.loads(r["json"]) for r in json_records(spark, str(tmp_path / "a.json")).orderBy("at").collect()] == [{"x": 1}, {"y": {"z": 2}}, {"w": []}]
    files.write_json_lines(spark.createDataFrame([('{"1": {"x": 3}}',)], "value string"), str(tmp_path / "l"))
    got = files.read_json_map(spark, str(tmp_path / "l"), T.StructType([T.StructField("x", T.IntegerType())])).collect()
    assert [tuple(r) for r in got] == [("1", 3)]
