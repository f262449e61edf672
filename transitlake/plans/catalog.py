"""Registry of every runnable query: key → function(spark, sf_dir) → DataFrame.

Each query binds the transit tables over the driver tables of ``sf_dir`` and
runs one report / product / job over the whole input. Doubles are rounded to
6 places for the cross-engine comparison (the report functions themselves
return full precision).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake.operators import districts, nest
from transitlake.operators.docviews import DocViews, arret_views, trafic_views, vehicule_views
from transitlake.plans import catalog_stored, products, quality, reports_doc, reports_rel
from transitlake.session import scratch_path, stored
from transitlake.sources.binding import Network, bind_network
from transitlake.sources.files import read_report, write_report

# A vehicle type that is not line 7's first one: the selectors then leave no stop.
OTHER_TYPE = "Hybride"

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([(F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
                      if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                      for f in df.schema.fields])


def _rounded_after(fn: Query) -> Query:
    return lambda spark, sf_dir: rounded(fn(spark, sf_dir))


def _net(spark: SparkSession, sf_dir: str) -> Network:
    return bind_network(spark, sf_dir)


def _docs(spark: SparkSession, sf_dir: str) -> DocViews:
    return DocViews.from_network(bind_network(spark, sf_dir))


def _rel(fn, **kw) -> Query:
    return lambda spark, sf_dir: rounded(fn(_net(spark, sf_dir), **kw))


def _doc(fn, **kw) -> Query:
    return lambda spark, sf_dir: rounded(fn(_docs(spark, sf_dir), **kw))


def _product(fn) -> Query:
    """fn(docs) → DataFrame, rounded."""
    return lambda spark, sf_dir: rounded(fn(_docs(spark, sf_dir)))


def ranked(df: DataFrame) -> DataFrame:
    """``df`` with ``rang``, each row's place in the frame's own order (results of a bounded size)."""
    seen = df.withColumn("_o", F.monotonically_increasing_id())
    return seen.withColumn("rang", F.row_number().over(Window.orderBy("_o"))).drop("_o")


def _over_doc(letter: str, fn, **kw) -> Query:
    """A dashboard figure over the document-profile result of one report."""
    return lambda spark, sf_dir: rounded(fn(reports_doc.REPORTS[letter](_docs(spark, sf_dir)), **kw))


def _over_file(letter: str, fn) -> Query:
    """The same figure over the report's file: written by its contract, read again by it."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark, f"mongo_requete_{letter}.csv")
        write_report(reports_doc.REPORTS[letter](_docs(spark, sf_dir)), path, letter)
        return rounded(fn(read_report(spark, path, letter)))
    return run


def _nested(letter: str) -> Query:
    """The document report over stored collections: the nest jobs' documents that the report reads are written as nested
    tables, scanned again and unwound."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        net = _net(spark, sf_dir)
        views: dict[str, DataFrame] = {}
        if letter in "bdehijm":
            views |= arret_views(stored(nest.nest_arrets(net), "Arrets"))
        if letter in "dkl":
            views |= vehicule_views(stored(nest.nest_vehicules(net), "Vehicules"))
        if letter in "acfgikn":
            views |= trafic_views(stored(nest.nest_trafic(net), "Trafic"))
        return rounded(reports_doc.REPORTS[letter](replace(DocViews.from_network(net), **views)))
    return run


def _nest_summary_arrets(max_items: int) -> Query:
    """Sizes of the documents' lists, and sums that change with any value or place in them."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = nest.nest_arrets(_net(spark, sf_dir), max_items=max_items)
        return docs.select(
            "id_arret", "part", F.size("quartiers").cast("long").alias("n_quartiers"), F.size("capteurs").cast("long").alias("n_capteurs"),
            F.expr("aggregate(capteurs, 0L, (a, c) -> a + size(c.mesures))").alias("n_mesures"), F.size("horaires").cast("long").alias("n_horaires"),
            F.expr("aggregate(transform(quartiers, (q, i) -> (i + 1) * q.id_quartier), 0L, (a, x) -> a + x)").alias("sum_quartiers"),
            F.expr("""aggregate(transform(capteurs, (c, e) -> aggregate(transform(c.mesures, (m, i) -> ((e + 1) * 31 + i + 1)
                * (c.id_capteur % 97 + cast(round(m.valeur * 10) as bigint) + day(m.horodatage))), 0L, (a, x) -> a + x)), 0L, (a, x) -> a + x)""")
            .alias("sum_mesures"),
            F.expr("""aggregate(transform(horaires, (h, i) -> (i + 1) * (h.id_vehicule + cast(nanvl(h.passagers_estimes, -1D) as bigint)
                + cast(substring(h.heure_prevue, 9, 2) as int))), 0L, (a, x) -> a + x)""").alias("sum_horaires"))
    return run


def _nest_vehicules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = nest.nest_vehicules(_net(spark, sf_dir))
    return v.select("id_vehicule", "immatriculation", "id_ligne", "type_vehicule", "capacite",
                    F.col("chauffeur.id_chauffeur").alias("id_chauffeur"), F.col("chauffeur.nom").alias("chauffeur_nom"),
                    F.col("chauffeur.date_embauche").alias("date_embauche"))


def _nest_trafic(max_items: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = nest.nest_trafic(_net(spark, sf_dir), max_items=max_items)
        return t.select("id_trafic", "part", "id_ligne", "retard_minutes", F.size("incidents").cast("long").alias("n_incidents"),
                        F.expr("""aggregate(transform(incidents, (x, i) -> (i + 1) * (x.gravite * 100 + day(x.horodatage))),
                            0L, (a, x) -> a + x)""").alias("sum_incidents"))
    return run


def _district_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid districts as the features that the district jobs read."""
    return districts.features_of(districts.quartiers_from_wkt(_net(spark, sf_dir).Quartier)[0])


def _quartiers_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = districts.quartiers_from_geojson(_district_features(spark, sf_dir))
    return docs.withColumn("n_points", F.size(F.get(F.col("geometry.coordinates"), 0)).cast("long")).drop("geometry")


def _apply_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    net, feats = _net(spark, sf_dir), _district_features(spark, sf_dir)
    docs, _ = districts.quartiers_from_wkt(net.Quartier)
    out = districts.apply_mapping(docs, districts.quartier_mapping(net.Quartier, feats), feats)
    return out.select("id_quartier", "nom", "nom_synthetique", "nom_reel", "arrondissement",
                      F.get(F.get(F.get(F.col("geometry.coordinates"), 0), 0), 0).alias("first_lon"), "is_real_paris")


def _quartiers_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = districts.quartiers_from_wkt(_net(spark, sf_dir).Quartier)
    ring = F.get(F.col("geometry.coordinates"), 0)
    return rounded(docs.select("id_quartier", "nom", F.size(ring).cast("long").alias("n_points"),
                               F.get(F.get(ring, 0), 0).alias("first_lon"), F.get(F.get(ring, 0), 1).alias("first_lat"),
                               F.get(F.get(ring, F.size(ring) - 1), 0).alias("last_lon"),
                               "is_real_paris"))


def _quartier_layer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DocViews]:
    net = _net(spark, sf_dir)
    q, _ = districts.quartiers_from_wkt(net.Quartier)
    return q, DocViews.from_network(net)


def _d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = _quartier_layer(spark, sf_dir)
    return rounded(products.quartier_features(d, q).drop("geometry"))


def _d10_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = _quartier_layer(spark, sf_dir)
    return products.feature_collection_lines(products.quartier_features(d, q))


def _board(**kw) -> Query:
    return _product(lambda d: products.stop_board(d, **kw))


def _parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _net(spark, sf_dir)
    d = DocViews.from_network(net)
    out = None
    for letter in reports_rel.REPORTS:
        part = quality.parity(letter, rounded(reports_rel.REPORTS[letter](net)),
                              rounded(reports_doc.REPORTS[letter](d)))
        out = part if out is None else out.unionByName(part)
    return out


def build() -> dict[str, Query]:
    q: dict[str, Query] = {}
    for letter, fn in reports_rel.REPORTS.items():
        q[f"R_{letter}_rel"] = _rel(fn)
    q["R_i_rel_trunc"] = _rel(reports_rel.report_i, truncate=True)
    for letter, fn in reports_doc.REPORTS.items():
        q[f"R_{letter}_doc"] = _doc(fn)
    for letter in reports_doc.REPORTS:
        q[f"R_{letter}_nested"] = _nested(letter)
    q["W1_corr_positional"] = _doc(reports_doc.report_i_positional)

    q["D01_line_vehicle_map"] = _product(products.line_vehicle_map)
    q["D02_stop_line_counts"] = _product(products.stop_line_counts)
    q["D03_line_options"] = _product(products.line_options)
    q["D03_vehicle_options"] = _product(products.vehicle_options)
    q["D04_stop_board"] = _board()
    q["D04_stop_board_medium"] = _board(co2_level="medium")
    q["D04_stop_board_diesel_low"] = _board(vehicle_type="Diesel", co2_level="low")
    q["D04_stop_board_line_7"] = _board(id_ligne=7)
    q["D04_stop_board_high"] = _board(co2_level="high")
    q["D04_stop_board_other_type"] = _board(id_ligne=7, vehicle_type=OTHER_TYPE)
    q["D05_co2_trend"] = _product(lambda d: products.co2_trend(d, products.stop_board(d, vehicle_type="Electrique")))
    q["D05_co2_trend_line_7"] = _product(lambda d: products.co2_trend(d, products.stop_board(d, id_ligne=7, co2_level="high")))
    q["D05_co2_trend_network"] = _product(products.co2_trend)
    q["D06_stop_markers"] = _product(lambda d: products.stop_markers(products.stop_board(d)))
    q["D06_map_centre"] = _product(lambda d: products.map_centre(products.stop_board(d)))
    q["D07_heat_points"] = _product(products.heat_points)
    q["D08_stop_details"] = _product(products.stop_details)
    q["D09_co2_by_quartier"] = _product(products.co2_by_quartier)
    q["D10_quartier_features"] = _d10
    q["D10_feature_json"] = _d10_json
    q["D11_noise_axis"] = _over_doc("e", products.noise_axis)
    q["D12_temp_extremes"] = _over_doc("j", lambda j: ranked(products.temp_extremes(j)))
    q["D12_temp_bounds"] = _over_doc("j", lambda j: products.temp_bounds(products.temp_extremes(j)))
    q["D13_worst_lines"] = _over_doc("a", lambda a: ranked(products.worst_lines(a)))
    q["D14_drivers_10"] = _over_doc("k", lambda k: ranked(products.drivers_ranked(k)))
    q["D14_drivers_bounds"] = _over_doc("k", lambda k: products.drivers_bounds(products.drivers_ranked(k)))
    q["D15_co2_histogram"] = _over_doc("d", products.co2_histogram)
    q["D16_delay_class_counts"] = _over_doc("n", products.delay_class_counts)
    q["D17_daily_passengers"] = _over_doc("b", products.daily_passengers)
    q["D18_electric_ranked"] = _over_doc("l", lambda x: ranked(products.electric_ranked(x)))
    q["D18_corr_ranked"] = _over_doc("i", lambda i: ranked(products.corr_ranked(i)))
    q["D18_incident_scatter"] = _over_doc("c", products.incident_scatter)
    q["D19_punctuality_pct"] = _over_doc("g", products.punctuality_pct)
    q["D13_worst_lines_from_csv"] = _over_file("a", lambda a: ranked(products.worst_lines(a)))
    q["D16_delay_class_counts_from_csv"] = _over_file("n", products.delay_class_counts)
    q["D17_daily_passengers_from_csv"] = _over_file("b", products.daily_passengers)
    q["D18_electric_ranked_from_csv"] = _over_file("l", lambda x: ranked(products.electric_ranked(x)))
    q["D20_selection_mix"] = _product(lambda d: products.selection_mix(products.stop_board(d)))

    q["M1_nest_lignes"] = lambda spark, sf_dir: nest.nest_lignes(_net(spark, sf_dir))
    q["M2_nest_arrets"] = _nest_summary_arrets(nest.DEFAULT_MAX_ITEMS)
    q["M2_nest_arrets_split"] = _nest_summary_arrets(5)
    q["M3_nest_vehicules"] = _nest_vehicules
    q["M4_nest_trafic"] = _nest_trafic(nest.DEFAULT_MAX_ITEMS)
    q["M4_nest_trafic_split"] = _nest_trafic(2)
    q["M5_quartiers_from_geojson"] = _quartiers_geojson
    q["M6_quartiers_from_wkt"] = _quartiers_wkt
    q["M6_rejects"] = lambda spark, sf_dir: districts.quartiers_from_wkt(_net(spark, sf_dir).Quartier)[1].select("id_quartier", "reason")
    q["M7_load_statistics"] = lambda spark, sf_dir: nest.load_statistics(
        _net(spark, sf_dir), districts.quartiers_from_geojson(_district_features(spark, sf_dir)))
    q["M8_quartier_mapping"] = lambda spark, sf_dir: districts.quartier_mapping(
        _net(spark, sf_dir).Quartier, _district_features(spark, sf_dir))
    q["M9_apply_mapping"] = _apply_mapping

    q["Q1_parity"] = _parity
    q["Q3_integrity"] = lambda spark, sf_dir: quality.integrity(_net(spark, sf_dir))
    return q | {key: _rounded_after(fn) for key, fn in catalog_stored.build().items()}
