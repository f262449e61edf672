"""The 14 reports, document profile.

Semantics of the document pipelines: unwinding drops empty lists and
children without a parent document (inner joins), lookups into the line
collection drop unknown lines, a missing number is NaN (a NaN in a group
makes its mean NaN, written as an empty field), groups of districts are by
name. Input is ``DocViews``; as in the relational profile, measures and
traffic are reduced per key before they meet the dimension views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.functions.calc import (day_of, day_of_text, delay_class, nan_to_null, pearson,
                                        pollution_level_doc, safe_div)
from transitlake.operators.docviews import DocViews
from transitlake.sources.binding import BUS_TYPE


def _lines(d: DocViews) -> DataFrame:
    return d.lignes.select("id_ligne", "nom_ligne")


def _sensor_type_sums(d: DocViews, sensor_type: str, key: str) -> DataFrame:
    """(Σ valeur, n) of the measures of one sensor type, per ``key`` of the
    owning stop (``id_arret`` or ``id_ligne``). NaN values propagate. The type filters the sensors
    first, so the measures of other types leave at the join."""
    sensors = d.sensors.filter(F.col("type_capteur") == sensor_type).select("id_capteur", key)
    return (d.measures.select("id_capteur", "valeur").join(sensors, "id_capteur")
            .groupBy(key).agg(F.sum("valeur").alias("s"), F.count(F.lit(1)).alias("n")))


def report_a(d: DocViews) -> DataFrame:
    per_line = d.traffic.groupBy("id_ligne").agg(F.avg("retard_minutes").alias("avg_retard"))
    return (per_line.join(_lines(d), "id_ligne")
            .orderBy("nom_ligne", "id_ligne").select("nom_ligne", "avg_retard"))


def report_b(d: DocViews) -> DataFrame:
    per_stop_day = (d.timetable.groupBy("id_arret", day_of_text("heure_prevue").alias("jour"))
                    .agg(F.sum("passagers_estimes").alias("s"), F.count(F.lit(1)).alias("n")))
    per_line_day = (per_stop_day.join(d.stops.select("id_arret", "id_ligne"), "id_arret")
                    .groupBy("id_ligne", "jour").agg((F.sum("s") / F.sum("n")).alias("avg_passagers")))
    return (per_line_day.join(_lines(d), "id_ligne")
            .orderBy("nom_ligne", F.asc_nulls_first("jour"), "id_ligne")
            .select("nom_ligne", "jour", nan_to_null("avg_passagers").alias("avg_passagers")))


def report_c(d: DocViews) -> DataFrame:
    per_line = d.traffic.groupBy("id_ligne").agg(
        safe_div(F.sum(F.coalesce("n_incidents", F.lit(0))), F.count(F.lit(1))).alias("incident_taux"))
    return (per_line.join(_lines(d), "id_ligne")
            .orderBy("nom_ligne", "id_ligne").select("nom_ligne", "incident_taux"))


def report_d(d: DocViews) -> DataFrame:
    """Vehicles × CO2 measures of the stops of their line, factored per line."""
    per_line = _sensor_type_sums(d, "CO2", "id_ligne")
    veh = d.vehicles.select("id_vehicule", "immatriculation", "type_vehicule", "id_ligne")
    return (veh.join(per_line, "id_ligne")
            .groupBy("id_vehicule", "immatriculation", "type_vehicule")
            .agg((F.sum("s") / F.sum("n")).alias("avg_co2"))
            .orderBy(F.asc_nulls_first("immatriculation"), "id_vehicule")
            .select("immatriculation", "type_vehicule", nan_to_null("avg_co2").alias("avg_co2")))


def _nan_last_desc(c: str):
    """Descending order where NaN ranks below every number (document order)."""
    return F.when(~F.isnan(F.col(c)), F.col(c)).desc_nulls_last()


def report_e(d: DocViews, k: int = 5) -> DataFrame:
    per_stop = _sensor_type_sums(d, "Bruit", "id_arret")
    return (per_stop.join(d.stop_districts.select("id_arret", "quartier_nom"), "id_arret")
            .groupBy("quartier_nom").agg((F.sum("s") / F.sum("n")).alias("avg_bruit"))
            .orderBy(_nan_last_desc("avg_bruit"), F.asc_nulls_first("quartier_nom"))
            .limit(k)
            .select("quartier_nom", nan_to_null("avg_bruit").alias("avg_bruit")))


def report_f(d: DocViews, min_delay: int = 10) -> DataFrame:
    """A stored incident list must be there and empty; a missing one (NULL size) does not match."""
    lines = (d.traffic.filter((F.col("retard_minutes") > min_delay) & (F.col("n_incidents") == 0))
             .select("id_ligne").distinct())
    return (lines.join(_lines(d), "id_ligne").select("nom_ligne").distinct().orderBy("nom_ligne"))


def report_g(d: DocViews) -> DataFrame:
    """Zero-delay share; 0 on an empty collection."""
    return d.traffic.agg(F.coalesce(safe_div(F.count_if(F.col("retard_minutes") == 0), F.count(F.lit(1))),
                                    F.lit(0.0)).alias("taux_sans_retard"))


def report_h(d: DocViews) -> DataFrame:
    return (d.stop_districts.groupBy("quartier_nom").agg(F.count(F.lit(1)).alias("arret_count"))
            .orderBy(F.desc("arret_count"), F.asc_nulls_first("quartier_nom"))
            .select("quartier_nom", "arret_count"))


def correlation_moments_doc(d: DocViews) -> DataFrame:
    """Per line, moments over (traffic, CO2 measure) pairs of the same line and
    day text (NULL day matches NULL day, as an expression equality does in
    the document store). ``N_raw`` counts all pairs, the moments only pairs
    whose two values are present (the client-side correlation drops the rest).
    """
    x = F.when(~F.isnan("valeur"), F.col("valeur"))
    sensors = d.sensors.filter(F.col("type_capteur") == "CO2").select("id_capteur", "id_ligne")
    co2 = (d.measures.join(sensors, "id_capteur")
           .groupBy("id_ligne", day_of("horodatage").alias("jour"))
           .agg(F.count(F.lit(1)).alias("n_all"), F.count(x).alias("n"),
                F.sum(x).alias("sx"), F.sum(x * x).alias("sxx")))
    y = F.col("retard_minutes").cast("double")
    traffic = (d.traffic.groupBy(F.col("id_ligne").alias("t_line"), day_of("horodatage").alias("t_jour"))
               .agg(F.count(F.lit(1)).alias("m_all"), F.count(y).alias("m"),
                    F.sum(y).alias("sy"), F.sum(y * y).alias("syy")))
    pairs = co2.join(traffic, (co2.id_ligne == traffic.t_line) & co2.jour.eqNullSafe(traffic.t_jour))
    return pairs.groupBy("id_ligne").agg(
        F.sum(F.col("n_all").cast("double") * F.col("m_all")).alias("N_raw"),
        F.sum(F.col("n").cast("double") * F.col("m")).alias("N"),
        F.sum(F.col("sx") * F.col("m")).alias("Sx"),
        F.sum(F.col("sy") * F.col("n")).alias("Sy"),
        F.sum(F.col("sxx") * F.col("m")).alias("Sxx"),
        F.sum(F.col("syy") * F.col("n")).alias("Syy"),
        F.sum(F.col("sx") * F.col("sy")).alias("Sxy"))


def report_i(d: DocViews) -> DataFrame:
    """Lines with more than one pair; NULL when fewer than two complete pairs
    or a variance is zero."""
    mom = correlation_moments_doc(d).filter(F.col("N_raw") > 1)
    return (mom.join(_lines(d), "id_ligne")
            .select("id_ligne", "nom_ligne",
                    F.when(F.col("N") > 1, pearson("N", "Sx", "Sy", "Sxx", "Syy", "Sxy")).alias("correlation"))
            .orderBy("nom_ligne", "id_ligne").select("nom_ligne", "correlation"))


def report_j(d: DocViews) -> DataFrame:
    per_line = _sensor_type_sums(d, "Temperature", "id_ligne")
    return (per_line.join(_lines(d), "id_ligne")
            .orderBy("nom_ligne", "id_ligne")
            .select("nom_ligne", nan_to_null(F.col("s") / F.col("n")).alias("avg_temperature")))


def report_k(d: DocViews) -> DataFrame:
    """Per driver, every traffic row of each of the driver's vehicles' lines
    (traffic joined directly, lines need not exist in the line collection)."""
    per_line = d.traffic.groupBy("id_ligne").agg(F.sum("retard_minutes").alias("s"),
                                                 F.count("retard_minutes").alias("n"))
    veh = d.vehicles.select("id_ligne", "id_chauffeur", "chauffeur_nom")
    return (veh.join(per_line, "id_ligne")
            .groupBy("id_chauffeur", "chauffeur_nom")
            .agg(safe_div(F.sum("s"), F.sum("n")).alias("avg"))
            .orderBy(F.asc_nulls_first("chauffeur_nom"), "id_chauffeur")
            .select("chauffeur_nom", F.col("avg").alias("avg_retard_minutes")))


def report_l(d: DocViews, bus_type: str = BUS_TYPE) -> DataFrame:
    """Every bus line; 0 when it has no vehicle."""
    per_line = d.vehicles.groupBy("id_ligne").agg(
        F.count_if(F.col("type_vehicule") == "Electrique").alias("e"), F.count(F.lit(1)).alias("v"))
    return (d.lignes.filter(F.col("type") == bus_type).join(per_line, "id_ligne", "left")
            .select("id_ligne", "nom_ligne",
                    F.when(F.col("v") > 0, safe_div("e", "v")).otherwise(F.lit(0.0)).alias("taux_electrique"))
            .orderBy("nom_ligne", "id_ligne").select("nom_ligne", "taux_electrique"))


def report_m(d: DocViews) -> DataFrame:
    sensors = d.sensors.filter(F.col("type_capteur") == "CO2").select(
        "id_capteur", F.col("cap_latitude").alias("latitude"), F.col("cap_longitude").alias("longitude"))
    return (d.measures.select("id_capteur", "horodatage", "valeur").join(sensors, "id_capteur")
            .orderBy("id_capteur", "horodatage", "valeur")
            .select("id_capteur", "latitude", "longitude", nan_to_null("valeur").alias("valeur"),
                    pollution_level_doc("valeur").alias("niveau_pollution")))


def report_n(d: DocViews) -> DataFrame:
    per_line = d.traffic.groupBy("id_ligne").agg(F.avg("retard_minutes").alias("avg_r"))
    return (per_line.join(_lines(d), "id_ligne")
            .orderBy("nom_ligne", "id_ligne")
            .select("nom_ligne", delay_class("avg_r").alias("classification_retard")))


REPORTS = {
    "a": report_a, "b": report_b, "c": report_c, "d": report_d, "e": report_e, "f": report_f,
    "g": report_g, "h": report_h, "i": report_i, "j": report_j, "k": report_k, "l": report_l,
    "m": report_m, "n": report_n,
}


def report_i_positional(d: DocViews) -> DataFrame:
    """Correlation of each line's CO2 values and delays paired by list
    position (traffic in id order, measures in stop / sensor / time order),
    cut to the shorter list; lines with fewer than two pairs or an undefined
    correlation are left out. A separate variant, not report i."""
    from transitlake.operators.positional import with_position
    t = with_position(d.traffic.select("id_ligne", "id_trafic", "retard_minutes"), ["id_ligne"],
                      ["id_trafic", "retard_minutes"])
    sensors = d.sensors.filter(F.col("type_capteur") == "CO2").select("id_capteur", "id_arret", "id_ligne")
    co2 = with_position(d.measures.join(sensors, "id_capteur")
                        .select("id_ligne", "id_arret", "id_capteur", "horodatage", "valeur"),
                        ["id_ligne"], ["id_arret", "id_capteur", "horodatage", "valeur"])
    x = F.when(~F.isnan("valeur") & F.col("retard_minutes").isNotNull(), F.col("valeur"))
    y = F.when(~F.isnan("valeur"), F.col("retard_minutes").cast("double"))
    mom = (t.join(co2, ["id_ligne", "pos"])
           .groupBy("id_ligne")
           .agg(F.count(F.lit(1)).alias("N_raw"), F.count(x).alias("N"), F.sum(x).alias("Sx"), F.sum(y).alias("Sy"),
                F.sum(x * x).alias("Sxx"), F.sum(y * y).alias("Syy"), F.sum(x * y).alias("Sxy")))
    corr = F.when(F.col("N") > 1, pearson("N", "Sx", "Sy", "Sxx", "Syy", "Sxy"))
    return (mom.filter(F.col("N_raw") > 1).join(_lines(d), "id_ligne")
            .select("id_ligne", "nom_ligne", corr.alias("correlation"))
            .filter(F.col("correlation").isNotNull())
            .orderBy("nom_ligne", "id_ligne").select("nom_ligne", "correlation"))
