"""Dashboard refresh: the stored board equals the direct board for every
selector combination; strict date parsing fails on bad text."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from helpers import rows
from transitlake.functions.calc import parse_ts_strict
from transitlake.operators.docviews import DocViews
from transitlake.plans import products as P
from transitlake.sources.binding import bind_network


@pytest.fixture(scope="module")
def docs(spark):
    return DocViews.from_network(bind_network(spark, SF_SMALL))


@pytest.fixture(scope="module")
def board(docs):
    return P.StopBoard.store(docs)


@pytest.mark.parametrize("kw", [{}, {"co2_level": "low"}, {"co2_level": "medium"}, {"co2_level": "high"},
                                {"vehicle_type": "Diesel"}, {"vehicle_type": "Electrique", "id_ligne": 3},
                                {"id_ligne": 0}, {"vehicle_type": "Hybride", "co2_level": "medium"}])
def test_stored_board_equals_direct(docs, board, kw):
    assert rows(board.select(**kw)) == rows(P.stop_board(docs, **kw))


def test_selections_prune_folders(board):
    plan = board.select(id_ligne=3, vehicle_type="Diesel")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "_line" in filters and "_first_type" in filters


def test_line_zero_is_a_real_line(docs):
    assert P.stop_board(docs, id_ligne=0).count() == docs.stops.filter(F.col("id_ligne") == 0).count()


def test_bad_co2_level(docs):
    with pytest.raises(ValueError):
        P.stop_board(docs, co2_level="extreme")


def test_trend_filters_whatever_the_size_of_the_selection(spark, docs):
    """A selection of more than 2000 rows still filters by its names."""
    name = docs.stops.first()["nom"]
    one = spark.range(3000).select(F.lit(name).alias("arret"))
    want = P.co2_trend(docs, docs.stops.filter(F.col("nom") == name).select(F.col("nom").alias("arret")))
    assert rows(P.co2_trend(docs, one)) == rows(want) != rows(P.co2_trend(docs))


def test_heat_points_keep_stops_without_coordinates(spark, docs):
    from dataclasses import replace
    bare = replace(docs, sensors=docs.sensors.withColumns({c: F.lit(None).cast("double") for c in ("latitude", "longitude")}))
    assert P.heat_points(bare).count() == P.heat_points(docs).count() > 0


def test_strict_parse(spark):
    ok = spark.createDataFrame([("2053-01-02 03:04:05",)], "t string").select(parse_ts_strict("t").alias("x"))
    assert ok.first()["x"].day == 2
    bad = spark.createDataFrame([("not a date",)], "t string").select(parse_ts_strict("t").alias("x"))
    with pytest.raises(Exception):
        bad.collect()
