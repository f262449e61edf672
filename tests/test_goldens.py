"""Dashboard figures and the district mapping from small result files whose figures were worked out by hand (``tests/fixtures``)."""

import json
import os

from transitlake import schema as S
from transitlake.functions.calc import delay_class
from transitlake.operators import districts as Q
from transitlake.plans import catalog_stored, products as P
from transitlake.sources.files import read_json_map, read_report

FIXTURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")


def _r(spark, letter):
    return read_report(spark, f"{FIXTURES}/requete_{letter}.csv", letter)


def test_n_from_a(spark):
    derived = {r[0]: r[1] for r in _r(spark, "a").select("nom_ligne", delay_class("avg_retard")).collect()}
    assert derived == {r[0]: r[1] for r in _r(spark, "n").collect()} and len(derived) == 12


def test_class_counts(spark):
    counts = {r[0]: r[1] for r in P.delay_class_counts(_r(spark, "n")).collect()}
    assert counts == {"retard moyen inf a 6min30": 4, "retard moyen inf a 7min": 3, "retard moyen sup a 7min": 5}


def test_worst_lines_and_extremes(spark):
    assert [r["nom_ligne"] for r in P.worst_lines(_r(spark, "a"), 4).collect()] == ["B11", "B8", "B7", "B6"]
    ext = [(r["groupe"], r["nom_ligne"]) for r in P.temp_extremes(_r(spark, "j"), 3).collect()]
    assert ext == [("top", "B12"), ("top", "B11"), ("top", "B10"), ("bottom", "B5"), ("bottom", "B1"), ("bottom", "B2")]  # a missing mean is coldest
    b = P.temp_bounds(P.temp_extremes(_r(spark, "j"), 3)).first()
    assert abs(b["y_min"] - 10.5 * 0.99) < 1e-12 and abs(b["y_max"] - 16 * 1.01) < 1e-12


def test_punctuality_banner(spark):
    assert P.punctuality_pct(_r(spark, "g")).first()["ponctualite_txt"] == "34.14%"


def test_rankings(spark):
    assert [r["nom_ligne"] for r in P.electric_ranked(_r(spark, "l")).collect()] == ["B2", "B1", "B4", "B3"]
    assert [r["nom_ligne"] for r in P.corr_ranked(_r(spark, "i")).collect()] == ["B2", "B4", "B1", "B3"]
    ax = P.noise_axis(_r(spark, "e")).first()
    assert abs(ax["y_min"] - 49) < 1e-12 and abs(ax["y_max"] - 80.8) < 1e-12


def test_mapping_file(spark, tmp_path):
    """The mapping made from features of those names is the file, and the file is read as the mapping."""
    path = f"{FIXTURES}/district_mapping.json"
    golden = json.load(open(path, encoding="utf-8"))
    feats = [{"type": "Feature", "properties": ({"l_qu": v["nom_reel"]} if v["nom_reel"] else {}) | ({"c_ar": v["arrondissement"]} if v["arrondissement"] else {}),
              "geometry": {"type": "Polygon", "coordinates": [[[2.3, 48.8], [2.4, 48.8], [2.3, 48.8]]]}} for v in golden.values()]
    (tmp_path / "q.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}), encoding="utf-8")
    synth = spark.createDataFrame([(i, f"Quartier-{i}", None) for i in range(1, 6)], S.QUARTIER)
    made = Q.quartier_mapping(synth, Q.read_features(spark, str(tmp_path / "q.geojson")))
    fields = list(golden["1"])
    assert {str(r["id_quartier"]): {f: r[f] for f in fields} for r in made.collect()} == golden  # the shorter list wins
    back = read_json_map(spark, path, catalog_stored.MAP_VALUE, "id_quartier")
    assert {r["id_quartier"]: {f: r[f] for f in fields} for r in back.collect()} == golden
    lines = [json.loads(r["value"]) for r in Q.mapping_json_lines(made).collect()]
    assert {k: v for d in lines for k, v in d.items()} == golden
