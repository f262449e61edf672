"""Registered queries over stored forms: collections behind a manifest, files read again in order or by the page, text tables with
rejects, GeoJSON and JSON-map files, the partitioned stop board. Each writes what Spark derives from the tables of ``sf_dir`` to a new
scratch folder and answers from what it reads there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake import schema as S
from transitlake.operators import districts, nest
from transitlake.operators.docviews import DocViews
from transitlake.operators.positional import with_position
from transitlake.plans import export, products, quality, reports_rel
from transitlake.session import scratch_path
from transitlake.sources import collections, files, loading, ordered
from transitlake.sources.binding import Network, bind_network, read_table

Query = Callable[[SparkSession, str], DataFrame]
FILE_ROWS = 10_000
MAP_VALUE = T.StructType([T.StructField("nom_synthetique", T.StringType()), T.StructField("nom_reel", T.StringType()),
                          T.StructField("arrondissement", T.IntegerType()), T.StructField("index_geojson", T.LongType())])


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with real properties, one for each part in key order; every property is missing somewhere, and some names hold
    the marks that JSON itself uses."""
    k, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    without = lambda n, c: F.when(k % n != 0, c)
    name = F.when(k % 13 == 0, F.concat("p_name", F.lit(' \\"}],{'))).otherwise(F.col("p_name"))
    props = F.struct(without(7, name).alias(districts.PROP_NAME), without(5, F.col("p_brand")).alias(districts.PROP_CODE),
                     without(11, size).alias(districts.PROP_ARR), without(3, price).alias(districts.PROP_SURFACE),
                     without(2, price / 4).alias(districts.PROP_PERIMETER))
    corner = lambda x, y: F.array((size + x).cast("double"), F.lit(float(y)))
    ring = F.array(corner(0, 48), corner(1, 48), corner(1, 49), corner(0, 48))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    rows = read_table(spark, sf_dir, "part").select("p_partkey", props.alias("p"), geometry.alias("geometry"))
    return with_position(rows, [], ["p_partkey"], name="idx").select("idx", "p", "geometry")


def _feature_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same features, written as FeatureCollections in order and read from them."""
    path = scratch_path(spark, "features.geojson")
    districts.write_features(part_features(spark, sf_dir), path)
    return districts.read_features(spark, path)


def geojson_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = districts.quartiers_from_geojson(_feature_file(spark, sf_dir))
    ring = F.get(F.col("geometry.coordinates"), 0)
    return docs.select(*[c for c in docs.columns if c != "geometry"], F.size(ring).cast("long").alias("n_points"),
                       F.get(F.get(ring, 1), 0).alias("second_lon"))


def written_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = bind_network(spark, sf_dir)
    real = districts.quartiers_from_geojson(part_features(spark, sf_dir))
    return export.export_collections(net, scratch_path(spark, "collections"), quartiers=real)


def _mapped(out: DataFrame) -> DataFrame:
    return out.select("id_quartier", "nom", "nom_synthetique", "nom_reel", "arrondissement",
                      F.get(F.get(F.get(F.col("geometry.coordinates"), 0), 0), 0).alias("first_lon"), "is_real_paris")


def upsert_from_json_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 written as one JSON map and read from it, then M9 on the stored district collection."""
    net, feats = bind_network(spark, sf_dir), part_features(spark, sf_dir)
    path, root = scratch_path(spark, "mapping.json"), scratch_path(spark, "Quartiers")
    files.write_json_map(districts.quartier_mapping(net.Quartier, feats), path, "id_quartier")
    mapping = files.read_json_map(spark, path, MAP_VALUE, "id_quartier").withColumn("id_quartier", F.col("id_quartier").cast("long"))
    collections.replace_collection(districts.quartiers_from_wkt(net.Quartier)[0], root, "id_quartier", parts=8)
    districts.apply_mapping_stored(root, mapping, feats)
    return _mapped(collections.read_collection(spark, root))


def replaced_by_itself(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vehicle collection, replaced by a selection of what it held."""
    root = scratch_path(spark, "Vehicules")
    collections.replace_collection(nest.nest_vehicules(bind_network(spark, sf_dir)), root)
    held = collections.read_collection(spark, root)
    collections.replace_collection(held.where("type_vehicule <> 'Diesel'").withColumn("capacite", F.col("capacite") + 1), root)
    return collections.read_collection(spark, root).select("id_vehicule", "type_vehicule", "capacite", F.col("chauffeur.nom").alias("chauffeur_nom"))


def write_text_copies(net: Network, root: str) -> None:
    """Trafic, Horaire and Incident as CSV text with bad rows among them: dates that are none, a word for a number,
    lines that stop after two fields; and missing values, which are not bad."""
    stamp = lambda c: F.date_format(c, loading.TS_FORMAT)
    trafic = net.Trafic.select(
        "id_trafic", "id_ligne", F.when(F.col("id_trafic") % 97 == 0, "2045-13-45 99:00:00").otherwise(stamp("horodatage")).alias("horodatage"),
        F.when(F.col("id_trafic") % 89 == 0, "douze").otherwise(F.col("retard_minutes").cast("string")).alias("retard_minutes"), "evenement")
    horaire = net.Horaire.select(
        "id_horaire", "id_arret", "id_vehicule", F.when(F.col("id_horaire") % 83 == 0, "hier").otherwise(stamp("heure_prevue")).alias("heure_prevue"),
        stamp("heure_effective").alias("heure_effective"), F.when(F.col("id_horaire") % 79 != 0, F.col("passagers_estimes")).alias("passagers_estimes"))
    whole = F.col("id_incident") % 101 != 0
    incident = net.Incident.where(whole).withColumn("horodatage", stamp("horodatage"))
    files.write_csv(trafic, f"{root}/Trafic")
    files.write_csv(horaire, f"{root}/Horaire")
    files.write_csv(incident, f"{root}/Incident")
    net.Incident.where(~whole).select("id_incident", "id_trafic").write.mode("append").option("header", True).csv(f"{root}/Incident")


def _loaded(spark: SparkSession, sf_dir: str) -> tuple[Network, DataFrame]:
    net, root = bind_network(spark, sf_dir), scratch_path(spark, "text")
    write_text_copies(net, root)
    return loading.load_network(spark, root, tables=["Trafic", "Horaire", "Incident"], base=net)


def load_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = _loaded(spark, sf_dir)
    key = F.coalesce(*[F.when(F.col("table_name") == t, F.get_json_object("row", f"$.{S.TABLES[t].fields[0].name}"))
                       for t in ("Trafic", "Horaire", "Incident")])
    return rejects.select("table_name", key.cast("long").alias("id"), "column_name", "value", "reason")


def _over_loaded(fn) -> Query:
    return lambda spark, sf_dir: fn(_loaded(spark, sf_dir)[0])


def loaded_rows(net: Network) -> DataFrame:
    """Rows that were loaded, with the missing values among them."""
    one = lambda n, c: getattr(net, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n"),
                                           F.count_if(F.col(c).isNull()).alias("n_missing"))
    return one("Trafic", "retard_minutes").unionByName(one("Horaire", "passagers_estimes")).unionByName(one("Incident", "gravite"))


def _written_report(spark: SparkSession, sf_dir: str, letter: str) -> str:
    path = scratch_path(spark, f"requete_{letter}.csv")
    report = files.project_contract(reports_rel.REPORTS[letter](bind_network(spark, sf_dir)), S.REPORT_COLUMNS[letter])
    ordered.write_ordered(report, path, FILE_ROWS)
    return path


def _reread(letter: str) -> Query:
    """A report written in order as many files and read again with each row's place."""
    return lambda spark, sf_dir: ordered.read_ordered(spark, _written_report(spark, sf_dir, letter), S.contract_schema(letter))


def _page(letter: str, number: int, size: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ordered.page(spark, _written_report(spark, sf_dir, letter), number, size, S.contract_schema(letter))
    return run


def page_of_a_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = quality.view_result(spark, _written_report(spark, sf_dir, "m"), 2, 25, S.contract_schema("m"))
    return rows.withColumn("n_rows", F.lit(n).cast("long"))


def result_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of a folder and their rows."""
    root, net = scratch_path(spark, "results"), bind_network(spark, sf_dir)
    for letter in "aln":
        files.write_report(reports_rel.REPORTS[letter](net), f"{root}/requete_{letter}.csv", letter)
    names = [r["result"] for r in files.list_result_files(spark, root).select("result").distinct().collect()]
    out = None
    for name in sorted(names):
        one = files.read_report(spark, f"{root}/{name}", name[8]).agg(F.lit(name).alias("result"), F.count(F.lit(1)).alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.preview(bind_network(spark, sf_dir).Quartier.orderBy("id_quartier"), 5, ("geojson",), 12)


def _board(fn) -> Query:
    return lambda spark, sf_dir: fn(products.StopBoard.store(DocViews.from_network(bind_network(spark, sf_dir))))


def build() -> dict[str, Query]:
    q: dict[str, Query] = {
        "M5_quartiers_from_geojson_file": geojson_file,
        "M7_written_statistics": written_statistics,
        "M9_upsert_from_json_map": upsert_from_json_map,
        "S8_replaced_by_itself": replaced_by_itself,
        "F4_load_rejects": load_rejects,
        "F4_loaded_rows": _over_loaded(loaded_rows),
        "F4_loaded_report_a": _over_loaded(reports_rel.REPORTS["a"]),
        "Q4_result_page": _page("m", 3, 50),
        "Q4_view_result": page_of_a_view,
        "S11_result_list": result_list,
        "S12_preview": previews,
        "D04_stored_board_line_7": _board(lambda b: b.select(id_ligne=7)),
        "D04_stored_board_diesel_low": _board(lambda b: b.select(vehicle_type="Diesel", co2_level="low")),
        "D20_stored_selection_mix": _board(lambda b: products.selection_mix(b.select())),
    }
    for letter in "bdkm":
        q[f"O2_report_{letter}_reread"] = _reread(letter)
    return q
