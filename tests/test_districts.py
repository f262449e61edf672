"""District jobs: WKT fallback (M6), GeoJSON load (M5), positional mapping
(M8) and upsert (M9)."""

import json

from pyspark.sql import functions as F

from helpers import rows
from transitlake import schema as S
from transitlake.operators import districts as Q


def test_wkt_fallback(spark):
    src = spark.createDataFrame([
        (1, "open", "POLYGON((2 48, 3 48, 3 49))"),
        (2, "closed", "POLYGON((1 1, 2 2, 3 1, 1 1))"),
        (3, "multi", "MULTIPOLYGON(((1 1, 2 2, 1 1)))"),
        (4, "bad", "POLYGON((a b, 1 2))"),
        (5, "json", '{"type": "Polygon", "coordinates": [[[1.0, 2.0], [3.0, 4.0], [1.0, 2.0]]]}'),
        (6, "spaced", "POLYGON ((1 2, 3 4))"),
        (7, "empty", "POLYGON(())"),
        (8, "three_d", "POLYGON((1 2 9, 3 4 9, 5 6 9))"),
    ], S.QUARTIER)
    docs, rejects = Q.quartiers_from_wkt(src)
    got = {r["id_quartier"]: r["geometry"]["coordinates"][0] for r in docs.collect()}
    assert got[1] == [[2.0, 48.0], [3.0, 48.0], [3.0, 49.0], [2.0, 48.0]]   # ring closed
    assert got[2] == [[1.0, 1.0], [2.0, 2.0], [3.0, 1.0], [1.0, 1.0]]
    assert got[5] == [[1.0, 2.0], [3.0, 4.0], [1.0, 2.0]]
    assert got[8] == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [1.0, 2.0]]       # extra ordinate ignored
    assert set(r[0] for r in rows(rejects, "id_quartier")) == {3, 4, 6, 7}
    assert docs.filter(F.col("is_real_paris")).count() == 0


def _write_geojson(tmp_path, features):
    p = tmp_path / "q.geojson"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": features}), encoding="utf-8")
    return str(p)


def _feature(props):
    return {"type": "Feature", "properties": props,
            "geometry": {"type": "Polygon", "coordinates": [[[2.3, 48.8], [2.4, 48.8], [2.3, 48.8]]]}}


def test_geojson_load_defaults(spark, tmp_path):
    path = _write_geojson(tmp_path, [_feature({"l_qu": "Gare", "c_qu": "12", "c_ar": 10, "surface": 1.5}),
                                     _feature({})])
    out = {r["id_quartier"]: r for r in Q.quartiers_from_geojson(Q.read_features(spark, path)).collect()}
    assert out[1]["nom"] == "Gare" and out[1]["arrondissement"] == 10 and out[1]["surface"] == 1.5
    assert out[2]["nom"] == "Quartier-2" and out[2]["code_quartier"] == "" and out[2]["arrondissement"] == 0
    assert out[2]["perimetre"] == 0.0 and out[1]["is_real_paris"]


def test_ids_do_not_repeat_over_several_files(spark, tmp_path):
    for i in range(3):
        _write_geojson(tmp_path, [_feature({"l_qu": f"{i}-{k}"}) for k in range(4)])
        (tmp_path / "q.geojson").rename(tmp_path / f"{i}.json")
    got = sorted((r["id_quartier"], r["nom"]) for r in Q.quartiers_from_geojson(Q.read_features(spark, str(tmp_path))).collect())
    assert got == [(1 + 4 * i + k, f"{i}-{k}") for i in range(3) for k in range(4)]


def test_features_are_written_by_many_tasks_and_read_in_order(spark, tmp_path):
    n, path = 95, str(tmp_path / "f.geojson")
    ring = F.array(F.array(F.array(F.col("idx").cast("double"), F.lit(48.0))))
    props = F.struct(*[F.when(F.col("idx") % 7 != 0, c).alias(name) for name, c in (
        (Q.PROP_NAME, F.concat(F.lit('"}],{ '), F.col("idx").cast("string"))), (Q.PROP_CODE, F.lit("c")), (Q.PROP_ARR, F.col("idx").cast("int")),
        (Q.PROP_SURFACE, F.col("idx") / 2), (Q.PROP_PERIMETER, F.lit(1.0)))])
    feats = spark.range(n).withColumnRenamed("id", "idx").select(
        "idx", props.alias("p"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"))
    Q.write_features(feats.repartition(5), path, per_file=10)
    written = sorted((tmp_path / "f.geojson").glob("file=*/part-*"))
    assert len(written) == 10
    assert [len(json.loads(f.read_text(encoding="utf-8"))["features"]) for f in written] == [10] * 9 + [5]
    got = sorted(tuple(r) for r in Q.read_features(spark, path).collect())
    assert [r[0] for r in got] == list(range(n)) and got == sorted(tuple(r) for r in feats.collect())
    Q.write_features(feats.limit(0), str(tmp_path / "e.geojson"))
    assert Q.read_features(spark, str(tmp_path / "e.geojson")).count() == 0


def test_upsert_sets_and_inserts(spark, tmp_path):
    cur = spark.createDataFrame([(1, "A", None), (2, "B", None), (3, "C", None)],
                                "id_quartier long, nom string, nom_reel string")
    upd = spark.createDataFrame([(2, "Real-B"), (4, "Real-D")], "id_quartier long, nom_reel string")
    out = rows(Q.upsert(cur, upd, "id_quartier"))
    assert out == [(1, "A", None), (2, "B", "Real-B"), (3, "C", None), (4, None, "Real-D")]


def test_apply_mapping(spark, tmp_path):
    path = _write_geojson(tmp_path, [_feature({"l_qu": "X", "c_ar": 3}), _feature({"l_qu": "Y", "c_ar": 4})])
    feats = Q.read_features(spark, path)
    synth = spark.createDataFrame([(1, "Quartier-1", "POLYGON((1 1, 2 2, 1 1))")], S.QUARTIER)
    docs, _ = Q.quartiers_from_wkt(synth)
    mapping = Q.quartier_mapping(synth, feats)
    out = Q.apply_mapping(docs, mapping, feats).collect()
    assert len(out) == 1 and out[0]["nom_reel"] == "X" and out[0]["arrondissement"] == 3
    assert out[0]["geometry"]["coordinates"][0][0] == [2.3, 48.8]
