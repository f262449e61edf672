"""Sources and sinks (S4, S6, S7, S8, S10, S11, S12), catalogue (Q2) and viewer (Q4)."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from transitlake import schema as S
from transitlake.plans import quality
from transitlake.sources import files
from transitlake.sources.binding import bind_network


def test_missing_csv_is_empty(spark, tmp_path):
    df = files.read_report(spark, str(tmp_path / "nope.csv"), "a")
    assert df.count() == 0 and df.columns == ["nom_ligne", "avg_retard"]


def test_report_roundtrip_with_contract(spark, tmp_path):
    df = spark.createDataFrame([("B1", float("nan"), "extra"), ("B2", 2.5, "x")],
                               "nom_ligne string, avg_retard double, junk string")
    path = str(tmp_path / "a")
    files.write_report(df.select("avg_retard", "nom_ligne", "junk"), path, "a")
    text = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.endswith(".csv"))
    assert text.splitlines()[0] == "nom_ligne,avg_retard"
    assert "B1," in text and "NaN" not in text           # NaN written as an empty field
    back = files.read_report(spark, path, "a")
    assert sorted(back.collect(), key=lambda r: r[0])[1]["avg_retard"] == 2.5


def test_contract_adds_missing_columns(spark):
    df = spark.createDataFrame([("v1",)], "immatriculation string")
    out = files.project_contract(df, S.REPORT_COLUMNS["d"])
    assert out.columns == ["immatriculation", "type_vehicule", "avg_co2"]
    assert out.first()["avg_co2"] is None


def test_empty_frame_writes_header(spark, tmp_path):
    df = spark.createDataFrame([], S.contract_schema("f"))
    path = str(tmp_path / "f")
    files.write_report(df, path, "f")
    text = "".join(open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".csv"))
    assert text.strip() == "nom_ligne"


def test_list_and_view_results(spark, tmp_path):
    for name in ("b_report", "a_report"):
        d = spark.range(45).select(F.col("id").alias("x"))
        d.coalesce(1).write.option("header", True).csv(str(tmp_path / name))
    listed = [r["name"] for r in files.list_result_files(spark, str(tmp_path)).collect()]
    assert listed == sorted(listed) and len(listed) == 2
    page, n = quality.view_result(spark, str(tmp_path / "a_report"), page=2, page_size=20)
    assert n == 45 and page.count() == 5


def test_collection_write_caps_rows_per_file(spark, tmp_path):
    path = str(tmp_path / "coll")
    files.write_collection(spark.range(25).coalesce(1), path, max_records_per_file=10)
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 3
    assert spark.read.parquet(path).count() == 25


def test_preview_cuts_text(spark):
    net = bind_network(spark, SF_SMALL)
    p = files.preview(net.Quartier, n=3, text_columns=("geojson",), width=8)
    assert p.count() == 3 and all(len(r["geojson"]) <= 8 for r in p.collect())


def test_schema_catalogue(spark):
    net = bind_network(spark, SF_SMALL)
    cat = quality.schema_catalogue(spark, net)
    pk = {(r["table"], r["column"]) for r in cat.filter("pk").collect()}
    assert ("ArretQuartier", "id_arret") in pk and ("Ligne", "id_ligne") in pk
    assert cat.filter(F.col("table") == "Horaire").count() == 6


def test_network_materialise_roundtrip(spark, tmp_path):
    from transitlake.plans import reports_rel as R
    from transitlake.sources.binding import read_network, write_network
    net = bind_network(spark, SF_SMALL)
    write_network(net, str(tmp_path))
    back = read_network(spark, str(tmp_path))
    for name, df in net.tables().items():
        other = back.tables()[name]
        assert df.schema == other.schema or [f.name for f in df.schema] == [f.name for f in other.schema]
        assert df.exceptAll(other).count() == 0 and other.exceptAll(df).count() == 0, name
    assert R.report_a(back).collect() == R.report_a(net).collect()


def test_session_time_zone_does_not_move_days(spark):
    """Timestamps are wall-clock values: a non-UTC session gives the same days."""
    from transitlake.plans import reports_rel as R
    from transitlake.sources import binding
    base = sorted(R.report_b(bind_network(spark, SF_SMALL)).collect(), key=str)
    tz = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    try:
        net = binding.bind_network(spark, SF_SMALL)
        assert sorted(R.report_b(net).collect(), key=str) == base
    finally:
        spark.conf.set("spark.sql.session.timeZone", tz)
        spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "true")


def test_appended_files_are_seen_in_the_same_session(spark, tmp_path):
    from transitlake.plans import catalog
    tables = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    for t in tables:
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    count = lambda: {r[0]: r[1] for r in catalog.build()["M7_load_statistics"](spark, str(tmp_path)).collect()}["mesures"]
    n = count()
    spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").write.mode("append").parquet(str(tmp_path / "lineitem.parquet"))
    assert count() == 2 * n > 0


def test_text_tables_fail_on_a_bad_date(spark, tmp_path):
    import pytest
    from transitlake.sources.binding import read_network
    net = bind_network(spark, SF_SMALL)
    for name, df in net.tables().items():
        df.limit(20).select([F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes]) \
            .write.option("header", True).csv(str(tmp_path / name))
    back = read_network(spark, str(tmp_path), "csv")
    assert back.Trafic.schema["horodatage"].dataType == net.Trafic.schema["horodatage"].dataType
    assert back.Trafic.where("horodatage is null").count() == 0 and back.Trafic.count() == 20
    spark.createDataFrame([(1, 1, "2045-13-45 99:00:00", 3, "x")], "id_trafic long, id_ligne long, horodatage string, retard_minutes long, evenement string") \
        .write.mode("append").option("header", True).csv(str(tmp_path / "Trafic"))
    with pytest.raises(Exception):
        read_network(spark, str(tmp_path), "csv").Trafic.collect()


def test_growing_reports_are_written_in_parts(spark, tmp_path):
    df = spark.range(100).repartition(4).select(F.col("id").alias("id_capteur"), *[F.lit(1.0).alias(c) for c in ("latitude", "longitude", "valeur")],
                                                F.lit("x").alias("niveau_pollution"))
    files.write_report(df, str(tmp_path / "m"), "m")
    parts = [f for f in os.listdir(tmp_path / "m") if f.endswith(".csv")]
    assert len(parts) > 1 and files.read_report(spark, str(tmp_path / "m"), "m").count() == 100
    assert all(open(tmp_path / "m" / f).readline().startswith("id_capteur,") for f in parts)
