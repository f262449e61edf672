"""Nest → unnest returns the flat rows, with and without document splitting,
and the document reports agree whichever form they read."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from helpers import rows
from transitlake.operators import nest
from transitlake.operators.docviews import DocViews
from transitlake.plans import reports_doc as D
from transitlake.plans.catalog import rounded
from transitlake.sources.binding import bind_network


def _views(net, max_items, persist=False):
    colls = [nest.nest_lignes(net), nest.nest_arrets(net, max_items=max_items),
             nest.nest_vehicules(net), nest.nest_trafic(net, max_items=max_items)]
    if persist:
        colls = [c.persist() for c in colls]
    return DocViews.from_collections(*colls)


@pytest.fixture(scope="module")
def net(spark):
    return bind_network(spark, SF_SMALL)


@pytest.fixture(scope="module")
def split_views(net):
    """Nested collections with tiny chunks (many overflow documents), built once."""
    return _views(net, 7, persist=True)


@pytest.mark.parametrize("max_items", [50_000, 7])
def test_unwound_views_equal(net, max_items):
    flat, nested = DocViews.from_network(net), _views(net, max_items)
    for name in ("stops", "stop_districts", "sensors", "timetable", "vehicles", "traffic"):
        a, b = getattr(flat, name), getattr(nested, name)
        if name == "timetable":  # rows of unknown stops are not attached to any document
            a = a.join(flat.stops.select("id_arret"), "id_arret", "left_semi")
        b = b.select(a.columns)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name
    # measures: only those attached to a stop's sensor survive nesting
    attached = flat.measures.join(flat.sensors.select("id_capteur"), "id_capteur", "left_semi")
    m = nested.measures.select(attached.columns)
    assert attached.exceptAll(m).count() == 0 and m.exceptAll(attached).count() == 0


def test_documents_are_bounded_and_numbered_from_zero(net):
    docs = nest.nest_arrets(net, max_items=7)
    sizes = docs.select("id_arret", "part", F.aggregate("capteurs", F.lit(0), lambda a, c: a + F.greatest(F.lit(1), F.size(c["mesures"]))).alias("n"),
                        F.size("horaires").alias("h"), F.size("quartiers").alias("q")).collect()
    assert max(r["n"] for r in sizes) == 7 and max(max(r["h"], r["q"]) for r in sizes) <= 7
    parts = {}
    for r in sizes:
        parts.setdefault(r["id_arret"], []).append(r["part"])
    assert all(sorted(p) == list(range(len(p))) for p in parts.values())
    assert {r["part"] for r in nest.nest_arrets(net).select("part").collect()} == {0}


def test_hot_parent_is_spread(spark, net):
    """One sensor with 20000 measures: bounded documents, in several tasks, with broadcasts off."""
    from transitlake.sources.binding import network_from_frames
    hot = spark.range(20_000).select(F.lit(net.Capteur.first()["id_capteur"]).alias("id_capteur"),
                                     F.lit("2050-01-01 00:00:00").cast("timestamp_ntz").alias("horodatage"),
                                     F.col("id").cast("double").alias("valeur"), F.lit("x").alias("unite"))
    n2 = network_from_frames({**net.tables(), "Mesure": hot})
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = nest.sensor_lists(n2, 100).select("part", F.spark_partition_id().alias("task"),
                                                F.expr("aggregate(capteurs, 0, (a, c) -> a + size(c.mesures))").alias("n")).where("n > 1").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["n"] for r in got) == 20_000 and max(r["n"] for r in got) <= 100 and len({r["task"] for r in got}) >= 4


@pytest.mark.parametrize("letter", list(D.REPORTS))
def test_doc_reports_same_on_nested_form(net, split_views, letter):
    a = rounded(D.REPORTS[letter](DocViews.from_network(net)))
    b = rounded(D.REPORTS[letter](split_views))
    assert rows(a) == rows(b)


def test_validation_rejects_null_line(spark, net):
    from transitlake.sources.binding import network_from_frames
    bad = net.Arret.withColumn("id_ligne", F.when(F.col("id_arret") == 1, None).otherwise(F.col("id_ligne")))
    n2 = network_from_frames({**net.tables(), "Arret": bad})
    with pytest.raises(Exception, match="NULL in id_ligne"):
        nest.nest_arrets(n2).collect()


def test_many_to_one_check(spark, net):
    from transitlake.sources.binding import network_from_frames
    dup = net.Chauffeur.unionByName(net.Chauffeur.limit(1))
    with pytest.raises(Exception, match="many-to-one"):
        nest.nest_vehicules(network_from_frames({**net.tables(), "Chauffeur": dup})).collect()


def test_missing_incident_list_is_not_an_empty_one(spark, net):
    """Report f asks for a list that is there and empty; report c counts a missing one as 0."""
    docs = nest.nest_trafic(net).withColumn("incidents", F.when(F.col("id_trafic") < 0, F.col("incidents")))
    from dataclasses import replace
    from transitlake.operators.docviews import trafic_views
    d = replace(DocViews.from_network(net), **trafic_views(docs))
    assert D.report_f(d).count() == 0
    assert {r["incident_taux"] for r in D.report_c(d).collect()} == {0.0}


def test_load_statistics(net):
    stats = dict(rows(nest.load_statistics(net)))
    assert stats["mesures"] == net.Mesure.count()
    assert stats["arrets"] == net.Arret.count()


def test_collections_roundtrip_through_parquet(spark, net, tmp_path):
    """S8 write of the collections, S3 read back with nested pruning, same reports."""
    from transitlake.sources.files import write_collection
    root = str(tmp_path)
    colls = {"lignes": nest.nest_lignes(net), "arrets": nest.nest_arrets(net, max_items=7),
             "vehicules": nest.nest_vehicules(net), "trafic": nest.nest_trafic(net, max_items=7)}
    for name, df in colls.items():
        write_collection(df, f"{root}/{name}", max_records_per_file=500)
    back = DocViews.from_collections(*(spark.read.parquet(f"{root}/{n}")
                                       for n in ("lignes", "arrets", "vehicules", "trafic")))
    flat = DocViews.from_network(net)
    for letter in ("b", "d", "e", "i", "m"):
        assert rows(rounded(D.REPORTS[letter](back))) == rows(rounded(D.REPORTS[letter](flat)))


def _own_network(spark, net):
    """Stop 1: 9 measures of two sensors, 3 timetable rows; stop 2: 4 measures (exactly ``max_items``) and 6 timetable rows; stop 3: one
    sensor without measures; one sensor row comes twice (stop 4), one has no stop, some measures no known sensor or none."""
    from transitlake.sources.binding import network_from_frames
    stops = spark.createDataFrame([(i, f"a{i}", 48.0, 2.0, 5) for i in (1, 2, 3, 4)], "id_arret long, nom string, latitude double, longitude double, id_ligne int")
    caps = spark.createDataFrame([(c, a, "CO2", 48.0, 2.0) for c, a in ((10, 1), (11, 1), (20, 2), (30, 3), (40, 4), (40, 4), (50, None))],
                                 "id_capteur long, id_arret long, type_capteur string, latitude double, longitude double")
    n = {10: 5, 11: 4, 20: 4, 40: 3, 50: 2, 99: 7, None: 6}
    values = spark.createDataFrame([(c, float(i), "x") for c, k in n.items() for i in range(k)], "id_capteur long, valeur double, unite string") \
        .withColumn("horodatage", F.lit("2050-01-01 00:00:00").cast("timestamp_ntz"))
    times = net.Horaire.limit(1).select(*[F.col(c) for c in net.Horaire.columns if c not in ("id_horaire", "id_arret")]).crossJoin(
        spark.createDataFrame([(i, 1 if i < 3 else 2 if i < 9 else None) for i in range(15)], "id_horaire long, id_arret long"))
    bridge = spark.createDataFrame([(1, 1), (2, 1)], "id_arret long, id_quartier long")
    incidents = spark.createDataFrame([(i, t) for i, t in enumerate([7] * 9 + [8] * 4 + [None] * 6)], "id_incident long, id_trafic long") \
        .withColumns({"description": F.lit("d"), "gravite": F.lit(1), "horodatage": F.lit("2050-01-01 00:00:00").cast("timestamp_ntz")})
    trafic = net.Trafic.limit(1).drop("id_trafic").crossJoin(spark.createDataFrame([(7,), (8,), (9,)], "id_trafic long"))
    return network_from_frames({**net.tables(), "Arret": stops, "Capteur": caps, "Mesure": values, "Horaire": times, "ArretQuartier": bridge,
                                "Incident": incidents, "Trafic": trafic})


def test_crowded_and_other_parents_side_by_side(spark, net):
    from transitlake.sources.collections import LoadCounts
    own, counts = _own_network(spark, net), LoadCounts()
    got = {}
    for r in nest.nest_arrets(own, max_items=4, counts=counts).collect():
        values = [[m["valeur"] for m in c["mesures"]] for c in r["capteurs"]]
        got[r["id_arret"], r["part"]] = ([c["id_capteur"] for c in r["capteurs"]], values, len(r["horaires"]), len(r["quartiers"]))
    assert got == {(1, 0): ([10], [[0, 1, 2, 3]], 3, 1), (1, 1): ([10, 11], [[4], [0, 1, 2]], 0, 0), (1, 2): ([11], [[3]], 0, 0),
                   (2, 0): ([20], [[0, 1, 2, 3]], 4, 1), (2, 1): ([], [], 2, 0), (3, 0): ([30], [[]], 0, 0),
                   (4, 0): ([40], [[0, 0, 1, 1]], 0, 0), (4, 1): ([40], [[2, 2]], 0, 0)}
    docs = {(r["id_trafic"], r["part"]): len(r["incidents"]) for r in nest.nest_trafic(own, max_items=4, counts=counts).collect()}
    assert docs == {(7, 0): 4, (7, 1): 4, (7, 2): 1, (8, 0): 4, (9, 0): 0}
    assert counts.rows() == {"mesures": 5 + 4 + 4 + 2 * 3 + 2 + 7, "incidents": 13}


def test_only_crowded_parents_are_numbered(spark, net, monkeypatch):
    """Lists that fit are grouped as they are: no sort over all children, no positions."""
    numbered, number = [], nest.with_position

    def spy(df, group, order):
        numbered.append({r[0] for r in df.select(group[0]).distinct().collect()})
        return number(df, group, order)
    monkeypatch.setattr(nest, "with_position", spy)
    own = _own_network(spark, net)
    assert nest.nest_arrets(own).count() == 4 and nest.nest_trafic(own).count() == 3 and numbered == []
    nest.nest_arrets(own, max_items=5), nest.nest_trafic(own, max_items=5)
    assert numbered == [{1, 2, 4}, {1, 2}, {1, 2}, {7}]  # stop 4: three measures of a sensor that comes twice


def test_keys_of_a_full_bucket_are_counted_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(nest, "BUCKETS", 1)
    keys = spark.createDataFrame([(k,) for k, n in {1: 5, 2: 4, 3: 6, None: 9}.items() for _ in range(n)], "k long")
    assert {r["k"] for r in nest.crowded(keys, "k", 4).collect()} == {1, 3}
    assert nest.crowded(keys, "k", 6) is None and nest.crowded(keys.where("k = 2"), "k", 4) is None
