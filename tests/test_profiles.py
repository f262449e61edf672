"""
one assertion per edge case where the relational and document forms part."""

import datetime as dt
import math

import pytest

from helpers import close, rows
from transitlake import schema as S
from transitlake.operators.docviews import DocViews
from transitlake.plans import reports_doc as D
from transitlake.plans import reports_rel as R
from transitlake.sources.binding import network_from_frames

TS = dt.datetime


def ts(day, hour=8):
    return TS(2053, 1, day, hour, 0, 0)


BASE = {
    # line 1 B1 has traffic; line 2 B2 has none; line 3 is a bus line without vehicles
    "Ligne": [(1, "B1", "Bus", 100), (2, "B2", "Bus", 200), (3, "B3", "Bus", 300), (4, "T1", "Tram", 50)],
    "Quartier": [(1, "Q-A", "POLYGON((2 48, 3 48, 3 49))"), (2, "Q-B", "POLYGON((1 1, 2 2, 1 1))"),
                 (3, "Q-empty", "MULTIPOLYGON(((1 1, 2 2, 1 1)))")],
    # stop 10 on line 1, stop 11 on line 2, stop 12 on unknown line 9
    "Arret": [(10, "S10", 48.8, 2.3, 1), (11, "S11", 48.9, 2.4, 2), (12, "S12", 48.7, 2.2, 9)],
    # bridge: stop 10 in Q-A and Q-B; unknown stop 99 in Q-A; stop 11 none
    "ArretQuartier": [(10, 1), (10, 2), (99, 1)],
    "Chauffeur": [(1, "Alice", dt.date(2040, 1, 1)), (2, "Bob", dt.date(2041, 1, 1))],
    # vehicle 103 has an unknown driver 7; vehicle 104 on unknown line 9
    "Vehicule": [(101, "AA-1", 1, 1, "Electrique", 50), (102, "AA-2", 1, 2, "Diesel", 60),
                 (103, "AA-3", 2, 7, "Hybride", 40), (104, "AA-4", 9, 1, "Diesel", 40)],
    # one timetable row of unknown stop 77, one NULL passenger count
    "Horaire": [(1, 10, 101, ts(1), ts(1), 20), (2, 10, 101, ts(1, 9), ts(1, 9), 30),
                (3, 11, 103, ts(2), ts(2), None), (4, 77, 101, ts(1), ts(1), 5)],
    # sensors: CO2 on stop 10 and 12, noise and temperature on stop 10
    "Capteur": [(1000, 10, "CO2", 48.8, 2.3), (1001, 10, "Bruit", 48.8, 2.3), (1002, 10, "Temperature", 48.8, 2.3),
                (1003, 12, "CO2", 48.7, 2.2)],
    "Mesure": [(1000, ts(1), 390.0, "ppm"), (1000, ts(1, 10), 510.0, "ppm"), (1000, ts(2), 450.0, "ppm"),
               (1001, ts(1), 60.0, "dB"), (1001, ts(1), None, "dB"),
               (1002, ts(1), 20.0, "C"), (1003, ts(1), 600.0, "ppm")],
    "Trafic": [(1, 1, ts(1), 0, "x"), (2, 1, ts(1, 12), 12, "x"), (3, 1, ts(2), 15, "x"), (4, 9, ts(1), 5, "x")],
    # two incidents on traffic 3, one on an unknown traffic row 50
    "Incident": [(1, 3, "a", 1, ts(2)), (2, 3, "b", 2, ts(2)), (3, 50, "c", 1, ts(2))],
}


@pytest.fixture(scope="module")
def net(spark):
    frames = {n: spark.createDataFrame(BASE[n], S.TABLES[n]) for n in S.TABLES}
    return network_from_frames(frames)


@pytest.fixture(scope="module")
def docs(net):
    return DocViews.from_network(net)


def test_a_line_without_traffic(net, docs):
    rel = dict(rows(R.report_a(net)))
    doc = dict(rows(D.report_a(docs)))
    assert rel["B2"] is None and "B2" in rel          # rel keeps the line with a NULL mean
    assert "B2" not in doc                             # doc drops it
    assert close(rel["B1"], 9.0) and close(doc["B1"], 9.0)


def test_b_orphans_and_missing_passengers(net, docs):
    rel = rows(R.report_b(net))
    doc = rows(D.report_b(docs))
    assert (None, "2053-01-01", 5.0) in rel            # unknown stop: NULL line group
    assert all(r[0] is not None for r in doc)          # doc drops it
    assert ("B2", "2053-01-02", None) in rel           # AVG over only NULL
    assert ("B2", "2053-01-02", None) in doc           # NaN mean written empty


def test_c_rates(net, docs):
    rel = dict(rows(R.report_c(net)))
    doc = dict(rows(D.report_c(docs)))
    assert close(rel["B1"], 2 / 3) and close(doc["B1"], 2 / 3)
    assert rel["B2"] is None and "B2" not in doc


def test_d_null_vehicle_group(net, docs):
    rel = rows(R.report_d(net))
    doc = rows(D.report_d(docs))
    # measures of stop 12 (line 9 not in Ligne) land in the NULL-vehicle row
    assert (None, None, 600.0) in rel
    assert all(r[0] is not None for r in doc)
    assert ("AA-1", "Electrique", 450.0) in rel and ("AA-1", "Electrique", 450.0) in doc


def test_e_grouping_and_nan(net, docs):
    rel = rows(R.report_e(net))
    doc = rows(D.report_e(docs))
    assert ("Q-A", 60.0) in rel and ("Q-B", 60.0) in rel   # AVG skips the NULL reading
    assert ("Q-A", None) in doc and ("Q-B", None) in doc   # the NaN reading voids the mean


def test_f_row_level_test(net, docs):
    assert rows(R.report_f(net)) == [("B1",)]
    assert rows(D.report_f(docs)) == [("B1",)]


def test_g_empty_table(spark, net):
    empty = spark.createDataFrame([], S.TRAFIC)
    n2 = network_from_frames({**net.tables(), "Trafic": empty})
    assert rows(R.report_g(n2)) == [(None,)]
    assert rows(D.report_g(DocViews.from_network(n2))) == [(0.0,)]


def test_h_counts(net, docs):
    rel = dict(rows(R.report_h(net)))
    doc = dict(rows(D.report_h(docs)))
    assert rel == {"Q-A": 2, "Q-B": 1, "Q-empty": 0}    # bridge row of unknown stop 99 counted
    assert doc == {"Q-A": 1, "Q-B": 1}                  # doc: only attached stops, no empty district


def test_i_single_pair_and_truncation(spark):
    base = {n: spark.createDataFrame(BASE[n], S.TABLES[n]) for n in S.TABLES}
    base["Mesure"] = spark.createDataFrame([(1000, ts(1), 400.0, "ppm")], S.MESURE)
    base["Trafic"] = spark.createDataFrame([(1, 1, ts(1), 3, "x")], S.TRAFIC)
    n1 = network_from_frames(base)
    assert rows(R.report_i(n1)) == [("B1", None)]          # n = 1 kept with NULL
    assert rows(D.report_i(DocViews.from_network(n1))) == []  # doc needs more than one pair


def test_i_zero_variance_kept_null(spark):
    base = {n: spark.createDataFrame(BASE[n], S.TABLES[n]) for n in S.TABLES}
    base["Mesure"] = spark.createDataFrame([(1000, ts(1), 400.0, "ppm"), (1000, ts(1), 410.0, "ppm")], S.MESURE)
    base["Trafic"] = spark.createDataFrame([(1, 1, ts(1), 3, "x"), (2, 1, ts(1), 3, "x")], S.TRAFIC)
    n1 = network_from_frames(base)
    assert rows(R.report_i(n1)) == [("B1", None)]
    assert rows(D.report_i(DocViews.from_network(n1))) == [("B1", None)]


def test_i_truncated_vs_real_division(spark):
    base = {n: spark.createDataFrame(BASE[n], S.TABLES[n]) for n in S.TABLES}
    # day 1: two measures x one delay; day 2: one measure x two delays -> N = 4, Sy = 17
    base["Mesure"] = spark.createDataFrame([(1000, ts(1), 400.0, "ppm"), (1000, ts(1), 430.0, "ppm"),
                                            (1000, ts(2), 420.0, "ppm")], S.MESURE)
    base["Trafic"] = spark.createDataFrame([(1, 1, ts(1), 3, "x"), (2, 1, ts(2), 4, "x"),
                                            (3, 1, ts(2), 7, "x")], S.TRAFIC)
    n1 = network_from_frames(base)
    real = rows(R.report_i(n1))[0][1]
    trunc = rows(R.report_i(n1, truncate=True))[0][1]
    doc = rows(D.report_i(DocViews.from_network(n1)))[0][1]
    assert close(real, doc, 1e-9)
    # Syy - Sy*Sy/N: 70 - 72.25 in real arithmetic, 70 - 72 truncated
    assert real is not None and trunc is not None and not close(real, trunc, 1e-6)
    assert abs(trunc) < abs(real)


def test_j_orphan_line(net, docs):
    rel = dict(rows(R.report_j(net)))
    assert rel == {"B1": 20.0}
    assert dict(rows(D.report_j(docs))) == {"B1": 20.0}


def test_k_unknown_driver_and_line(net, docs):
    rel = dict(rows(R.report_k(net)))
    doc = dict(rows(D.report_k(docs)))
    assert close(rel["Alice"], 9.0) and close(rel["Bob"], 9.0) and None not in rel
    # doc: vehicle 104 of Alice runs on line 9 (absent from Ligne) and still counts
    assert close(doc["Alice"], (27 + 5) / 4)
    assert "Bob" in doc and None not in doc            # vehicle 103 (driver 7) has no traffic on line 2


def test_l_bus_line_without_vehicle(net, docs):
    rel = dict(rows(R.report_l(net, bus_type="Bus")))
    doc = dict(rows(D.report_l(docs, bus_type="Bus")))
    assert rel == {"B1": 0.5, "B2": 0.0}
    assert doc == {"B1": 0.5, "B2": 0.0, "B3": 0.0}


def test_m_null_value_band(spark):
    base = {n: spark.createDataFrame(BASE[n], S.TABLES[n]) for n in S.TABLES}
    base["Mesure"] = spark.createDataFrame([(1000, ts(1), None, "ppm"), (1000, ts(1), 450.0, "ppm")], S.MESURE)
    n1 = network_from_frames(base)
    rel = {(r[3], r[4]) for r in R.report_m(n1).collect()}
    doc = {(r[3], r[4]) for r in D.report_m(DocViews.from_network(n1)).collect()}
    assert (None, "élevé") in rel and (450.0, "moyen") in rel
    assert (None, "faible") in doc and (450.0, "moyen") in doc


def test_n_classes(net, docs):
    rel = dict(rows(R.report_n(net)))
    doc = dict(rows(D.report_n(docs)))
    assert rel["B2"] == "retard moyen sup a 7min"        # NULL mean falls in the ELSE class
    assert "B2" not in doc
    assert rel["B1"] == doc["B1"] == "retard moyen sup a 7min"


def test_bad_timestamp_text_gives_null_day(spark, docs):
    from pyspark.sql import functions as F
    tt = docs.timetable.withColumn("heure_prevue", F.when(F.col("id_arret") == 11, F.lit("not a date"))
                                   .otherwise(F.col("heure_prevue")))
    d2 = DocViews(**{**docs.__dict__, "timetable": tt})
    out = rows(D.report_b(d2))
    assert ("B2", None, None) in out
    assert not any(isinstance(r[2], float) and math.isnan(r[2]) for r in out)
