"""Batch entry points: report CSVs in both profiles and the migration."""

import os

from conftest import SF_SMALL
from transitlake.plans import export
from transitlake.sources.binding import bind_network
from transitlake.sources.collections import read_collection
from transitlake.sources.files import read_report


def test_export_reports_both_profiles(spark, tmp_path):
    net = bind_network(spark, SF_SMALL)
    rel = export.export_reports(net, str(tmp_path), "rel")
    doc = export.export_reports(net, str(tmp_path), "doc")
    assert len(rel) == len(doc) == 14
    a = read_report(spark, str(tmp_path / "requete_a.csv"), "a")
    assert a.columns == ["nom_ligne", "avg_retard"] and a.count() == net.Ligne.count()
    g = read_report(spark, str(tmp_path / "mongo_requete_g.csv"), "g").first()
    assert 0 <= g["taux_sans_retard"] <= 1


def test_migration_writes_collections(spark, tmp_path):
    net = bind_network(spark, SF_SMALL)
    stats = {r["collection"]: r["n"] for r in export.export_collections(net, str(tmp_path)).collect()}
    assert set(os.listdir(tmp_path)) >= {"Lignes", "Arrets", "Vehicules", "Trafic", "Quartiers"}
    assert read_collection(spark, str(tmp_path / "Arrets")).count() == stats["arrets"]
    rejected = read_collection(spark, str(tmp_path / "Quartiers_rejets")).count()
    assert stats["quartiers"] + rejected == net.Quartier.count() and rejected > 0 and stats["quartiers_reels"] == 0
