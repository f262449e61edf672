"""Batch entry points: the report scripts and the migration of the reference.

* ``export_reports`` writes every report of one profile as a header CSV
  (``requete_<x>.csv`` for the relational profile, ``mongo_requete_<x>.csv``
  for the document profile), each through its column contract (S6 + S7).
* ``export_collections`` writes the document collections (M1–M4, plus the
  district documents of M6) as versioned collections and returns the load statistics (M7).

CLI::

    python -m transitlake.plans.export reports  <sf_dir> <out_dir> [rel|doc|both]
    python -m transitlake.plans.export migrate  <sf_dir> <out_dir>
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.operators import districts, nest
from transitlake.operators.docviews import DocViews
from transitlake.plans import reports_doc, reports_rel
from transitlake.sources.binding import Network, bind_network
from transitlake.sources.collections import LoadCounts, replace_collection
from transitlake.sources.files import write_report

FILE_PREFIX = {"rel": "requete_", "doc": "mongo_requete_"}


def export_reports(net: Network, out_dir: str, profile: str = "rel") -> list[str]:
    """Write the 14 reports of ``profile`` under ``out_dir``; returns the paths."""
    src = net if profile == "rel" else DocViews.from_network(net)
    reports = reports_rel.REPORTS if profile == "rel" else reports_doc.REPORTS
    paths = []
    for letter, fn in reports.items():
        path = f"{out_dir.rstrip('/')}/{FILE_PREFIX[profile]}{letter}.csv"
        write_report(fn(src), path, letter)
        paths.append(path)
    return paths


def export_collections(net: Network, out_dir: str, max_items: int = nest.DEFAULT_MAX_ITEMS, quartiers: DataFrame | None = None) -> DataFrame:
    """Replace the collections under ``out_dir`` and return their load statistics (M7), counted as they are written.
    Without ``quartiers`` (from a GeoJSON file) the districts come from their table, unreadable ones to ``Quartiers_rejets``."""
    root, counts = out_dir.rstrip("/"), LoadCounts()
    every = F.lit(True)
    head = F.col("part") == 0
    if quartiers is None:
        quartiers, rejects = districts.quartiers_from_wkt(net.Quartier)
        replace_collection(rejects, f"{root}/Quartiers_rejets")
    jobs = {
        "Lignes": (nest.nest_lignes(net), None, {"lignes": every}),
        "Arrets": (nest.nest_arrets(net, max_items=max_items, counts=counts), None, {"arrets": head}),
        "Vehicules": (nest.nest_vehicules(net), None, {"vehicules": every}),
        "Trafic": (nest.nest_trafic(net, max_items=max_items, counts=counts), None, {"trafic": head}),
        "Quartiers": (quartiers, "id_quartier", {"quartiers": every, "quartiers_reels": F.col("is_real_paris")}),
    }
    for name, (df, key, counted) in jobs.items():  # the districts are upserted later, so they are dealt to parts by key
        replace_collection(df, f"{root}/{name}", key, counts=counts, counted=counted)
    return net.Ligne.sparkSession.createDataFrame(sorted(counts.rows().items()), "collection string, n long")


def main(argv: list[str]) -> int:
    from transitlake.session import get_spark
    if len(argv) < 3 or argv[0] not in ("reports", "migrate"):
        print(__doc__)
        return 2
    spark: SparkSession = get_spark("transitlake-export")
    net = bind_network(spark, argv[1])
    if argv[0] == "reports":
        profiles = {"both": ("rel", "doc")}.get(argv[3] if len(argv) > 3 else "both",
                                                 (argv[3],) if len(argv) > 3 else ())
        for p in profiles:
            for path in export_reports(net, argv[2], p):
                print(path)
    else:
        export_collections(net, argv[2]).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
