"""The 14 reports, relational profile (SQL semantics: LEFT joins keep NULL
groups, AVG skips NULLs, x/0 is NULL).

Plan shape, everywhere the input is a fact table (Mesure, Trafic, Incident,
Horaire): reduce it per join key first (partial + final hash aggregate, so a
hot key is combined map-side and never lands whole in one task), then join
the small per-key sums to the dimensions. Joins between a fact table and a
dimension are left to AQE, which broadcasts the dimension when its measured
size is under the threshold and shuffles (with skew splitting) otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.functions.calc import day_of, delay_class, pearson, pollution_level, safe_div
from transitlake.sources.binding import BUS_TYPE, Network


def _traffic_by_line(net: Network) -> DataFrame:
    """Σ delay, non-NULL count and row count per line id (Trafic reduced once)."""
    return net.Trafic.groupBy("id_ligne").agg(
        F.sum("retard_minutes").alias("s"), F.count("retard_minutes").alias("n"),
        F.count(F.lit(1)).alias("rows"))


def _sensor_sums_by_stop(net: Network, sensor_type: str) -> DataFrame:
    """(Σ valeur, n) per Capteur.id_arret for one sensor type (the WHERE on the
    type makes the Capteur join inner). The type filters the sensors first, so the measures of
    other types leave at the join."""
    caps = net.Capteur.filter(F.col("type_capteur") == sensor_type).select("id_capteur", "id_arret")
    return (net.Mesure.select("id_capteur", "valeur").join(caps, "id_capteur")
            .groupBy("id_arret").agg(F.sum("valeur").alias("s"), F.count("valeur").alias("n")))


def _stop_line_key(net: Network, per_stop: DataFrame) -> DataFrame:
    """Attach Ligne.id_ligne through LEFT JOIN Arret LEFT JOIN Ligne (NULL when
    the stop or its line is unknown), as column ``L``."""
    stop_line = net.Arret.select("id_arret", F.col("id_ligne").alias("a_line"))
    lines = net.Ligne.select(F.col("id_ligne").alias("L"), "nom_ligne")
    return (per_stop.join(stop_line, "id_arret", "left")
            .join(lines, F.col("a_line") == F.col("L"), "left")
            .drop("a_line"))


def report_a(net: Network) -> DataFrame:
    """Mean delay per line; a line without traffic keeps a NULL mean."""
    t = _traffic_by_line(net)
    return (net.Ligne.join(t, "id_ligne", "left")
            .groupBy("id_ligne", "nom_ligne")
            .agg(safe_div(F.sum("s"), F.sum("n")).alias("avg_retard"))
            .orderBy("nom_ligne", "id_ligne")
            .select("nom_ligne", "avg_retard"))


def report_b(net: Network) -> DataFrame:
    """Mean passengers per line and day; timetable rows of an unknown stop or
    line form the NULL-line group."""
    per_stop_day = (net.Horaire.groupBy("id_arret", day_of("heure_prevue").alias("jour"))
                    .agg(F.sum("passagers_estimes").alias("s"), F.count("passagers_estimes").alias("n")))
    keyed = _stop_line_key(net, per_stop_day)
    return (keyed.groupBy("L", "nom_ligne", "jour")
            .agg(safe_div(F.sum("s"), F.sum("n")).alias("avg_passagers"))
            .orderBy(F.asc_nulls_first("nom_ligne"), F.asc_nulls_first("jour"), "L")
            .select("nom_ligne", "jour", "avg_passagers"))


def report_c(net: Network) -> DataFrame:
    """Incidents per distinct traffic row, per line. Incidents are counted per
    traffic id first, so the join never fans out."""
    inc = net.Incident.groupBy("id_trafic").agg(F.count("id_incident").alias("n_inc"))
    per_traffic = (net.Trafic.select("id_trafic", "id_ligne").join(inc, "id_trafic", "left")
                   .groupBy("id_ligne", "id_trafic")
                   .agg(F.sum(F.coalesce("n_inc", F.lit(0))).alias("n_inc")))
    per_line = per_traffic.groupBy("id_ligne").agg(F.sum("n_inc").alias("n_inc"),
                                                   F.count("id_trafic").alias("n_traffic"))
    return (net.Ligne.join(per_line, "id_ligne", "left")
            .groupBy("id_ligne", "nom_ligne")
            .agg(safe_div(F.sum(F.coalesce("n_inc", F.lit(0))),
                          F.nullif(F.sum(F.coalesce("n_traffic", F.lit(0))), F.lit(0))).alias("incident_taux"))
            .orderBy("nom_ligne", "id_ligne")
            .select("nom_ligne", "incident_taux"))


def report_d(net: Network) -> DataFrame:
    """Mean CO2 per vehicle. The mean depends only on the line (factored form):
    (Σ, n) per line — one pass over the measures — then one LEFT join to the
    vehicles of the line. Measures whose line is unknown or has no vehicle
    meet no vehicle and form the single NULL-vehicle row, as in the SQL."""
    per_line = (_stop_line_key(net, _sensor_sums_by_stop(net, "CO2"))
                .groupBy("L").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    veh = net.Vehicule.select("id_vehicule", "immatriculation", "type_vehicule", "id_ligne")
    return (per_line.join(veh, per_line.L == veh.id_ligne, "left")
            .groupBy("id_vehicule", "immatriculation", "type_vehicule")
            .agg(safe_div(F.sum("s"), F.sum("n")).alias("avg_co2"))
            .orderBy(F.asc_nulls_first("immatriculation"), "id_vehicule")
            .select("immatriculation", "type_vehicule", "avg_co2"))


def report_e(net: Network, k: int = 5) -> DataFrame:
    """Top-k noisiest districts. Measures are reduced per stop, then spread over
    the stop's districts (each bridge row counts the stop's measures once)."""
    per_stop = _sensor_sums_by_stop(net, "Bruit")
    known = per_stop.join(net.Arret.select(F.col("id_arret").alias("a_id")),
                          F.col("id_arret") == F.col("a_id"), "left")
    bridge = net.ArretQuartier.select(F.col("id_arret").alias("b_arret"), F.col("id_quartier").alias("b_q"))
    quart = net.Quartier.select(F.col("id_quartier").alias("Q"), "nom")
    rows = (known.join(bridge, F.col("a_id") == F.col("b_arret"), "left")
            .join(quart, F.col("b_q") == F.col("Q"), "left"))
    return (rows.groupBy("Q", "nom")
            .agg(safe_div(F.sum("s"), F.sum("n")).alias("avg_bruit"))
            .orderBy(F.desc_nulls_last("avg_bruit"), F.asc_nulls_first("nom"), "Q")
            .limit(k)
            .select(F.col("nom").alias("quartier_nom"), "avg_bruit"))


def report_f(net: Network, min_delay: int = 10) -> DataFrame:
    """Lines having a late traffic row (> min_delay) with no incident at all.
    ``LEFT JOIN … IS NULL`` is written as an anti join."""
    late = net.Trafic.filter(F.col("retard_minutes") > min_delay).select("id_trafic", "id_ligne")
    lonely = late.join(net.Incident.select("id_trafic"), "id_trafic", "left_anti")
    lines = lonely.select("id_ligne").distinct()
    return (net.Ligne.join(lines, "id_ligne", "left_semi")
            .select("nom_ligne").distinct()
            .orderBy("nom_ligne"))


def report_g(net: Network) -> DataFrame:
    """Share of traffic rows with zero delay; NULL on an empty table."""
    return net.Trafic.agg(
        safe_div(F.count_if(F.col("retard_minutes") == 0), F.count(F.lit(1))).alias("taux_sans_retard"))


def report_h(net: Network) -> DataFrame:
    """Bridge rows per district (an empty district counts 0)."""
    per_q = net.ArretQuartier.groupBy("id_quartier").agg(F.count("id_arret").alias("c"))
    return (net.Quartier.join(per_q, "id_quartier", "left")
            .groupBy("id_quartier", "nom")
            .agg(F.sum(F.coalesce("c", F.lit(0))).cast("long").alias("arret_count"))
            .orderBy(F.desc("arret_count"), "nom", "id_quartier")
            .select(F.col("nom").alias("quartier_nom"), "arret_count"))


def correlation_moments_rel(net: Network, exact: bool = False) -> DataFrame:
    """Per line: the pair moments of (CO2 value, delay) over all pairs that share
    line and day, without materialising the pairs (factored form).

    Each side is reduced to one row per (line, day) before the join. Measures
    reach their line through the CO2 sensor → line map, which AQE broadcasts when its measured
    bytes allow and otherwise joins by shuffle (splitting hot sensors).

    Per (line, day) keep n, Σx, Σx² of measures and m, Σy, Σy² of traffic;
    over the pairs COUNT(*) = Σ n·m, SUM(x) = Σ Σx·m, SUM(x·y) = Σ Σx·Σy, …
    n and m count all rows (COUNT(*) semantics); the sums skip NULLs. Counts of pairs and sums over
    them outgrow a long, so they are doubles, or decimal(38,0) with ``exact``.
    """
    x = F.col("valeur")
    kind = "decimal(38,0)" if exact else "double"
    # sensor → line map of the CO2 sensors (a dimension: one row per sensor)
    sensor_line = (net.Capteur.filter(F.col("type_capteur") == "CO2").select("id_capteur", "id_arret")
                   .join(net.Arret.select("id_arret", "id_ligne"), "id_arret")
                   .join(net.Ligne.select("id_ligne", "nom_ligne"), "id_ligne")
                   .select("id_capteur", "id_ligne", "nom_ligne"))
    co2 = (net.Mesure.filter(F.col("horodatage").isNotNull()).join(sensor_line, "id_capteur")
           .groupBy("id_ligne", "nom_ligne", day_of("horodatage").alias("jour"))
           .agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx")))
    y = F.col("retard_minutes").cast("decimal(18,0)" if exact else "double")
    traffic = (net.Trafic.filter(F.col("horodatage").isNotNull())
               .groupBy("id_ligne", day_of("horodatage").alias("jour"))
               .agg(F.count(F.lit(1)).alias("m"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")))
    pairs = co2.join(traffic, ["id_ligne", "jour"])
    n, m = F.col("n").cast(kind), F.col("m").cast(kind)
    return pairs.groupBy("id_ligne", "nom_ligne").agg(
        F.sum((n * m).cast(kind)).alias("N"),
        F.sum(F.col("sx") * F.col("m").cast("double")).alias("Sx"),
        F.sum((F.col("sy").cast(kind) * n).cast(kind)).alias("Sy"),
        F.sum(F.col("sxx") * F.col("m").cast("double")).alias("Sxx"),
        F.sum((F.col("syy").cast(kind) * n).cast(kind)).alias("Syy"),
        F.sum(F.col("sx") * F.col("sy").cast("double")).alias("Sxy"))


def report_i(net: Network, truncate: bool = False) -> DataFrame:
    """CO2 × delay correlation per line over same-day pairs (closed form).
    ``truncate=True`` evaluates Σy·Σy/N in integer arithmetic, as the
    reference's SQL engine does with integer delays."""
    mom = correlation_moments_rel(net, exact=truncate)
    return (mom.select("id_ligne", "nom_ligne",
                       pearson("N", "Sx", "Sy", "Sxx", "Syy", "Sxy", truncate_y=truncate).alias("correlation"))
            .orderBy("nom_ligne", "id_ligne")
            .select("nom_ligne", "correlation"))


def report_j(net: Network) -> DataFrame:
    """Mean temperature per line; measures of an unknown stop/line form the NULL group."""
    keyed = _stop_line_key(net, _sensor_sums_by_stop(net, "Temperature"))
    return (keyed.groupBy("L", "nom_ligne")
            .agg(safe_div(F.sum("s"), F.sum("n")).alias("avg_temperature"))
            .orderBy(F.asc_nulls_first("nom_ligne"), "L")
            .select("nom_ligne", "avg_temperature"))


def report_k(net: Network) -> DataFrame:
    """Mean delay per driver; each traffic row of a line counts once per
    vehicle of the driver on that line (factored: Σ and n per line)."""
    per_line = _traffic_by_line(net).join(net.Ligne.select("id_ligne"), "id_ligne")
    drivers = net.Chauffeur.select("id_chauffeur", F.col("nom").alias("chauffeur_nom"))
    veh = net.Vehicule.select("id_chauffeur", "id_ligne").join(drivers, "id_chauffeur")
    return (veh.join(per_line, "id_ligne")
            .groupBy("id_chauffeur", "chauffeur_nom")
            .agg(safe_div(F.sum("s"), F.sum("n")).alias("avg_retard_minutes"))
            .orderBy(F.asc_nulls_first("chauffeur_nom"), "id_chauffeur")
            .select("chauffeur_nom", "avg_retard_minutes"))


def report_l(net: Network, bus_type: str = BUS_TYPE) -> DataFrame:
    """Share of electric vehicles per bus line (lines with vehicles only)."""
    per_line = net.Vehicule.groupBy("id_ligne").agg(
        F.count_if(F.col("type_vehicule") == "Electrique").alias("e"), F.count(F.lit(1)).alias("v"))
    bus = net.Ligne.filter(F.col("type") == bus_type)
    return (bus.join(per_line, "id_ligne")
            .groupBy("id_ligne", "nom_ligne")
            .agg(safe_div(F.sum("e"), F.sum("v")).alias("taux_electrique"))
            .orderBy("nom_ligne", "id_ligne")
            .select("nom_ligne", "taux_electrique"))


def report_m(net: Network) -> DataFrame:
    """CO2 band of every CO2 measure (row-level; NULL value falls in the ELSE band)."""
    caps = net.Capteur.filter(F.col("type_capteur") == "CO2").select("id_capteur", "latitude", "longitude")
    # time and value break ties inside a sensor, so the range partitioning of
    # the sort can split one very large sensor over many tasks
    return (net.Mesure.select("id_capteur", "horodatage", "valeur").join(caps, "id_capteur")
            .orderBy("id_capteur", "horodatage", "valeur")
            .select("id_capteur", "latitude", "longitude", "valeur",
                    pollution_level("valeur").alias("niveau_pollution")))


def report_n(net: Network) -> DataFrame:
    """Delay class per line from the mean of report a (NULL mean → last class)."""
    t = _traffic_by_line(net)
    return (net.Ligne.join(t, "id_ligne", "left")
            .groupBy("id_ligne", "nom_ligne")
            .agg(delay_class(safe_div(F.sum("s"), F.sum("n"))).alias("classification_retard"))
            .orderBy("nom_ligne", "id_ligne")
            .select("nom_ligne", "classification_retard"))


REPORTS = {
    "a": report_a, "b": report_b, "c": report_c, "d": report_d, "e": report_e, "f": report_f,
    "g": report_g, "h": report_h, "i": report_i, "j": report_j, "k": report_k, "l": report_l,
    "m": report_m, "n": report_n,
}
