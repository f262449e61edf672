"""Every registered query against its DuckDB twin (row multiset equality)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
import oracle_twins
from conftest import SF_CHECK, SF_SMALL
from transitlake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()
ORACLES = oracle_twins.oracle_sql()
QUERIES = catalog.build()


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        t = []
        for i in order:
            v = r[i]
            if isinstance(v, float) and v != v:
                v = None
            if hasattr(v, "isoformat"):
                v = v.isoformat()
            t.append(v)
        out.append(tuple(t))
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_is_registered_with_a_callable():
    assert len(QUERIES) >= 95 and set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    got = _canon([tuple(r) for r in df.collect()], df.columns)
    res = duck.execute(ORACLES[key])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert got == _canon(res.fetchall(), ocols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "arret" in df.columns


# The columns each report is sorted by: (column, descending, NULL first).
ORDERS = {"a": [("nom_ligne", 0, 1)], "b": [("nom_ligne", 0, 1), ("jour", 0, 1)], "c": [("nom_ligne", 0, 1)], "d": [("immatriculation", 0, 1)],
          "e": [("avg_bruit", 1, 0), ("quartier_nom", 0, 1)], "f": [("nom_ligne", 0, 1)], "h": [("arret_count", 1, 0), ("quartier_nom", 0, 1)],
          "i": [("nom_ligne", 0, 1)], "j": [("nom_ligne", 0, 1)], "k": [("chauffeur_nom", 0, 1)], "l": [("nom_ligne", 0, 1)],
          "m": [("id_capteur", 0, 1)], "n": [("nom_ligne", 0, 1)]}


@pytest.mark.parametrize("profile", ["rel", "doc"])
@pytest.mark.parametrize("letter", sorted(ORDERS))
def test_reports_come_sorted(spark, letter, profile):
    got = [tuple(r[c] for c, _, _ in ORDERS[letter]) for r in QUERIES[f"R_{letter}_{profile}"](spark, SF_SMALL).collect()]
    want = list(got)
    for i, (_, down, first) in reversed(list(enumerate(ORDERS[letter]))):
        have = sorted((r for r in want if r[i] is not None), key=lambda r: r[i], reverse=bool(down))
        none = [r for r in want if r[i] is None]
        want = none + have if first else have + none
    assert got == want and len(got) > 0
    if len({r[0] for r in got}) > 1:
        assert got != got[::-1]


def test_selections_keep_some_and_drop_some(spark):
    n = {k: QUERIES[k](spark, SF_CHECK).count() for k in QUERIES if k.startswith(("D04", "D05"))}
    levels = [n[f"D04_stop_board{s}"] for s in ("", "_medium", "_high")]
    assert 0 < levels[1] < levels[0] and 0 < levels[2] < levels[0] and n["D04_stop_board_other_type"] == 0
    assert 0 < n["D04_stop_board_line_7"] < levels[0] and 0 < n["D04_stop_board_diesel_low"] < levels[0]
    assert QUERIES["R_f_rel"](spark, SF_CHECK).count() < QUERIES["D03_line_options"](spark, SF_CHECK).count()
    of = {k: {r["date"]: r["moyenne_co2"] for r in QUERIES[k](spark, SF_CHECK).collect()} for k in QUERIES if k.startswith("D05")}
    assert of["D05_co2_trend_line_7"] and of["D05_co2_trend_line_7"] != of["D05_co2_trend_network"]
