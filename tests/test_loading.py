"""Text tables with a reject channel (F4), results in order and by the page."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL
from helpers import rows
from transitlake import schema as S
from transitlake.plans import catalog_stored, quality
from transitlake.sources import files, loading, ordered
from transitlake.sources.binding import bind_network, read_network

TRAFIC = """id_trafic,id_ligne,horodatage,retard_minutes,evenement
1,7,2045-01-02 03:04:05,12,ok
2,7,2045-13-45 99:00:00,3,month
3,x,hier,4.5,three
4,,,,
5,7,2045-01-02 03:04:05
6,7,2045-02-30 00:00:00,1,day
7,7,2045-01-02 03:04:05,9,"a, b"
8,7,2045-01-02 03:04:05,9,b,too many
"""


def test_every_row_is_loaded_or_rejected_with_its_reason(spark, tmp_path):
    (tmp_path / "Trafic").mkdir()
    (tmp_path / "Trafic" / "t.csv").write_text(TRAFIC, encoding="utf-8")
    loaded, rejects = loading.load_table(spark, str(tmp_path / "Trafic"), "Trafic")
    assert loaded.schema["horodatage"].dataType == S.TABLES["Trafic"]["horodatage"].dataType
    assert [(r["id_trafic"], r["retard_minutes"], r["evenement"]) for r in loaded.orderBy("id_trafic").collect()] == [(1, 12, "ok"), (4, None, None), (7, 9, "a, b")]
    got = sorted((json.loads(r["row"])["id_trafic"], r["column_name"] or "", r["value"], r["reason"]) for r in rejects.collect())
    assert got == [("2", "horodatage", "2045-13-45 99:00:00", "bad timestamp"), ("3", "horodatage", "hier", "bad timestamp"), ("3", "id_ligne", "x", "not a number"),
                   ("3", "retard_minutes", "4.5", "not a number"), ("5", "", "5,7,2045-01-02 03:04:05", "malformed line"),
                   ("6", "horodatage", "2045-02-30 00:00:00", "bad timestamp"), ("8", "", "8,7,2045-01-02 03:04:05,9,b,too many", "malformed line")]
    # a report that reads two columns sees the same rows
    assert loaded.select("id_trafic").count() == 3 and loaded.agg(F.sum("retard_minutes")).first()[0] == 21


def test_strict_mode_still_fails(spark, tmp_path):
    (tmp_path / "Trafic").mkdir()
    (tmp_path / "Trafic" / "t.csv").write_text(TRAFIC, encoding="utf-8")
    with pytest.raises(Exception):
        read_network(spark, str(tmp_path), "csv").Trafic.collect()


def test_clean_copies_load_whole(spark, tmp_path):
    net = bind_network(spark, SF_SMALL)
    for name in ("Chauffeur", "Mesure"):
        df = getattr(net, name)
        files.write_csv(df.select([F.date_format(c, loading.TS_FORMAT).alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes]), str(tmp_path / name))
    back, rejects = loading.load_network(spark, str(tmp_path), tables=["Chauffeur", "Mesure"], base=net)
    assert rejects.count() == 0
    for name in ("Chauffeur", "Mesure", "Ligne"):
        a, b = getattr(net, name), getattr(back, name)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


NUMBERS = T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.StringType())])


@pytest.fixture(scope="module")
def numbers(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("o") / "r.csv")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(1000).select((999 - F.col("id")).alias("x"), F.concat(F.lit("v, "), F.col("id").cast("string")).alias("y"))
    ordered.write_ordered(df.orderBy("x"), path, rows_per_file=30)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return path


def test_order_across_part_files(spark, numbers):
    parts = [f for f in os.listdir(numbers) if f.endswith(".csv")]
    assert len(parts) > 30
    got = sorted((r["rang"], r["x"], r["y"]) for r in ordered.read_ordered(spark, numbers, NUMBERS).collect())
    assert got == [(i + 1, i, f"v, {999 - i}") for i in range(1000)]


@pytest.mark.parametrize("number,size", [(0, 20), (3, 50), (7, 130), (49, 20), (50, 20), (9, 100)])
def test_pages(spark, numbers, number, size):
    got = [(r["rang"], r["x"]) for r in ordered.page(spark, numbers, number, size, NUMBERS).collect()]
    assert got == [(i + 1, i) for i in range(number * size, min(1000, (number + 1) * size))]
    assert ordered.count_rows(spark, numbers, NUMBERS) == 1000


def test_a_page_opens_only_its_files(spark, numbers):
    df = ordered.page(spark, numbers, 3, 50, NUMBERS)
    assert 1 <= len(df.inputFiles()) <= 4 < len([f for f in os.listdir(numbers) if f.endswith(".csv")])


def test_results_without_an_index(spark, tmp_path):
    path = str(tmp_path / "plain")
    spark.range(45).select(F.col("id").alias("x"), F.lit("a").alias("y")).coalesce(1).write.option("header", True).csv(path)
    page, n = quality.view_result(spark, path, 2, 20, NUMBERS)
    assert n == 45 and [r["x"] for r in page.collect()] == list(range(40, 45))
    page, n = quality.view_result(spark, str(tmp_path / "none"), 0, 20, NUMBERS)
    assert n == 0 and page.count() == 0 and page.columns == ["x", "y"]
    files.write_csv(spark.createDataFrame([], NUMBERS), str(tmp_path / "empty"))
    assert quality.view_result(spark, str(tmp_path / "empty"), 0, 20, NUMBERS)[0].count() == 0


def test_planted_rows_are_rejected(spark):
    rejects = catalog_stored.load_rejects(spark, SF_SMALL)
    assert {r["reason"] for r in rejects.collect()} == {"bad timestamp", "not a number", "malformed line"}
    assert rows(rejects.groupBy("table_name").count()) and rejects.where("id is null").count() == 0
