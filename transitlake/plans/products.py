"""Tables behind the operations dashboard.

The dashboard reads the document store and the document-profile result
files, so these products consume ``DocViews`` and ``reports_doc``. Maps and
charts are not drawn; each function returns the rows a chart would plot.
Column names are ASCII snake case; the dashboard's display labels are noted
in the docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake.functions.calc import day_of, nan_to_null
from transitlake.operators.docviews import DocViews
from transitlake.plans import reports_doc
from transitlake.session import scratch_path

# Fixed values used by the dashboard.
UNKNOWN = "Inconnu"
NAMELESS_STOP = "Arrêt sans nom"
DEFAULT_CENTRE = (48.8566, 2.3522)
CO2_LEVELS = ("all", "low", "medium", "high")


# --- D1–D3: start-up maps and options ----------------------------------------

def line_vehicle_map(d: DocViews) -> DataFrame:
    """First vehicle type per line (first = lowest vehicle id)."""
    first = d.vehicles.groupBy("id_ligne").agg(F.min("id_vehicule").alias("id_vehicule"))
    return (d.vehicles.select("id_ligne", "id_vehicule", "type_vehicule").join(first, ["id_ligne", "id_vehicule"])
            .select("id_ligne", "type_vehicule"))


def stop_line_counts(d: DocViews) -> DataFrame:
    """Number of distinct lines per stop name (connection hubs)."""
    return d.stops.groupBy("nom").agg(F.count_distinct("id_ligne").alias("nb_lignes"))


def line_options(d: DocViews) -> DataFrame:
    """D3: line selector (label = name, value = id), sorted by name."""
    return d.lignes.select(F.col("nom_ligne").alias("label"), F.col("id_ligne").alias("value")) \
        .orderBy("label", "value")


def vehicle_options(d: DocViews) -> DataFrame:
    """D3: sorted distinct vehicle types of D1."""
    return line_vehicle_map(d).select(F.col("type_vehicule").alias("label")).distinct().orderBy("label")


# Below, bands, colours, labels and factors are fixed values of the dashboard.

# --- per-stop sensor summary (shared by D4 and D8) ---------------------------

def _sensor_means(d: DocViews, with_db_test: bool, stops: DataFrame | None = None) -> DataFrame:
    """Mean of each sensor's measures (sensors without measures are skipped),
    classified by substring of the type, then one value per stop and class:
    the sensor last in list order (highest id) wins. ``stops`` keeps only their sensors, before
    any measure is aggregated."""
    t = F.col("type_capteur")
    noise = t.contains("Bruit") | F.lower(t).contains("db") if with_db_test else t.contains("Bruit")
    cls = F.when(t.contains("CO2"), "co2").when(noise, "bruit").when(t.contains("Temp"), "temp")
    sensors = d.sensors.select("id_arret", "id_capteur", cls.alias("cls"))
    if stops is not None:
        sensors = sensors.join(stops.select("id_arret"), "id_arret", "left_semi")
    rows = (d.measures.select("id_capteur", "valeur").join(sensors, "id_capteur")
            .groupBy("id_arret", "id_capteur", "cls").agg((F.sum("valeur") / F.count(F.lit(1))).alias("avg")))

    def last(c):
        return F.max_by(F.when(F.col("cls") == c, F.col("avg")), F.when(F.col("cls") == c, F.col("id_capteur")))
    return rows.groupBy("id_arret").agg(last("co2").alias("co2"), last("bruit").alias("bruit"),
                                        last("temp").alias("temp"))


def _truthy_round(c: str, digits: int = 1):
    """Rounded value, or NULL when the value is missing or zero."""
    v = F.col(c)
    return F.when(v.isNotNull() & (v != 0), F.round(v, digits))


def _co2_filter(co2_level: str | None):
    v, nan = F.col("co2"), F.isnan(F.col("co2"))
    if co2_level in (None, "all"):
        return F.lit(True)
    if co2_level == "low":
        return nan | (v <= 400)
    if co2_level == "medium":
        return ~nan & (v >= 400) & (v <= 480)
    if co2_level == "high":
        return nan | (v > 480)
    raise ValueError(f"co2_level must be one of {CO2_LEVELS}")


def stop_board(d: DocViews, id_ligne: int | None = None, vehicle_type: str | None = None,
               co2_level: str | None = "all") -> DataFrame:
    """Filtered stop board.

    Columns (dashboard labels): arret (Arrêt), quartier (Quartier),
    type_vehicule (Type Véhicule), nb_lignes (Nb Lignes), latitude, longitude,
    co2_ppm (CO2 (ppm), 0 when the stop has no CO2 reading), bruit_db
    (Bruit (dB)), temp_c (Temp (°C)). A vehicle type keeps the lines whose
    first vehicle has that type; a line outside that set gives no rows.
    co2_level: low ≤ 400, medium 400–480 (both inclusive), high > 480.
    """
    lvm = line_vehicle_map(d)
    stops = d.stops
    if vehicle_type is not None:
        targets = lvm.filter(F.col("type_vehicule") == vehicle_type).select("id_ligne")
        stops = stops.join(targets, "id_ligne", "left_semi")
    if id_ligne is not None:
        stops = stops.filter(F.col("id_ligne") == F.lit(id_ligne))
    chosen = stops if vehicle_type is not None or id_ligne is not None else None
    return _board_columns(_board_rows(d, stops, chosen).filter(_co2_filter(co2_level)))


class StopBoard:
    """Dashboard refresh (D4 + D20 + D5 per selector change): the stop-level wide table (one row per stop: sensors
    summarised, district, vehicle type, connections) is stored once, partitioned by line and by the line's first vehicle
    type; a selection reads only the folders of its line and type. Any session reads it by its path."""

    LAYOUT = ("_line", "_first_type")

    def __init__(self, wide: DataFrame):
        self.wide = wide

    @classmethod
    def store(cls, d: DocViews, path: str | None = None) -> "StopBoard":
        """Build the table below ``path`` (default: a scratch folder) and open it."""
        rows_ = _board_rows(d, d.stops).select("*", F.col("id_ligne").alias("_line"), F.col("v_type").alias("_first_type"))
        spark = rows_.sparkSession
        path = path or scratch_path(spark, "stop-board")
        # a line's stops lie together, so that a task writes to few folders; a very long line spans several tasks
        rows_.repartitionByRange("_line", "id_arret").write.mode("overwrite").partitionBy(*cls.LAYOUT).parquet(path)
        return cls.open(spark, path, rows_.schema)

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: T.StructType) -> "StopBoard":
        return cls(spark.read.schema(schema).parquet(path))

    def select(self, id_ligne: int | None = None, vehicle_type: str | None = None,
               co2_level: str | None = "all") -> DataFrame:
        rows_ = self.wide
        if vehicle_type is not None:
            rows_ = rows_.filter(F.col("_first_type") == vehicle_type)
        if id_ligne is not None:
            rows_ = rows_.filter(F.col("_line") == F.lit(id_ligne))
        return _board_columns(rows_.filter(_co2_filter(co2_level)))


def _board_rows(d: DocViews, stops: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    first_district = d.stop_districts.groupBy("id_arret").agg(
        F.min_by("quartier_nom", "id_quartier").alias("quartier"), F.count(F.lit(1)).alias("nq"))
    return (stops.join(_sensor_means(d, with_db_test=True, stops=chosen), "id_arret", "left")
            .withColumn("co2", F.coalesce("co2", F.lit(0.0)))
            .join(first_district, "id_arret", "left")
            .join(line_vehicle_map(d).withColumnRenamed("type_vehicule", "v_type"), "id_ligne", "left")
            .join(stop_line_counts(d), "nom", "left"))


def _board_columns(board: DataFrame) -> DataFrame:
    return board.select(
        "id_arret",
        F.col("nom").alias("arret"),
        F.when(F.col("nq") > 0, F.col("quartier")).otherwise(F.lit(UNKNOWN)).alias("quartier"),
        F.coalesce("v_type", F.lit(UNKNOWN)).alias("type_vehicule"),
        F.coalesce("nb_lignes", F.lit(1)).cast("long").alias("nb_lignes"),
        "latitude", "longitude",
        nan_to_null(F.round("co2", 1)).alias("co2_ppm"),
        nan_to_null(_truthy_round("bruit")).alias("bruit_db"),
        nan_to_null(_truthy_round("temp")).alias("temp_c"))


def co2_trend(d: DocViews, selection: DataFrame | None = None) -> DataFrame:
    """Daily mean CO2 over the stops whose *name* is in the selection
    (a D4 frame), or over the whole network when there is none. Columns: date (Date), moyenne_co2.
    A selection filters whatever its size: names → stops → sensors → measures."""
    sensors = d.sensors.filter(F.col("type_capteur") == "CO2")
    if selection is not None:
        sensors = sensors.join(selection.select(F.col("arret").alias("nom")).distinct(), "nom", "left_semi")
    daily = (d.measures.join(sensors.select("id_capteur"), "id_capteur", "left_semi")
             .groupBy(day_of("horodatage").alias("date")).agg(F.sum("valeur").alias("s"), F.count(F.lit(1)).alias("n")))
    return (daily.select("date", (F.col("s") / F.col("n")).alias("moyenne_co2"))
            .orderBy(F.asc_nulls_first("date"))
            .select("date", nan_to_null("moyenne_co2").alias("moyenne_co2")))


def stop_markers(board: DataFrame) -> DataFrame:
    """Marker colour by CO2 band (> 400 orange, > 480 red, > 550 darkred)
    and icon by connections (more than one line: exchange)."""
    v = F.col("co2_ppm")
    colour = (F.when(v > 550, "darkred").when(v > 480, "red").when(v > 400, "orange").otherwise("green"))
    icon = F.when(F.col("nb_lignes") > 1, "exchange").otherwise("bus")
    tooltip = F.concat(F.col("arret"), F.lit(" ("), F.col("co2_ppm").cast("string"), F.lit(" ppm)"))
    return board.select("id_arret", "arret", "latitude", "longitude", "co2_ppm",
                        colour.alias("couleur"), icon.alias("icone"), tooltip.alias("infobulle"))


def map_centre(board: DataFrame) -> DataFrame:
    """Map centre = mean position of the board (default centre when empty)."""
    return board.agg(F.coalesce(F.avg("latitude"), F.lit(DEFAULT_CENTRE[0])).alias("centre_lat"),
                     F.coalesce(F.avg("longitude"), F.lit(DEFAULT_CENTRE[1])).alias("centre_lon"))


def heat_points(d: DocViews) -> DataFrame:
    """Per stop, mean of all measures of its CO2/pollution sensors; only
    strictly positive means. A built document always has a location, so stops with NULL
    coordinates stay."""
    sensors = d.sensors.filter(F.col("type_capteur").rlike("(?i)CO2|Pollution"))
    per_stop = (d.measures.select("id_capteur", "valeur")
                .join(sensors.select("id_capteur", "id_arret", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")),
                      "id_capteur")
                .groupBy("id_arret", "lat", "lon").agg((F.sum("valeur") / F.count(F.lit(1))).alias("valeur")))
    return per_stop.filter(~F.isnan("valeur") & (F.col("valeur") > 0)).select("id_arret", "lat", "lon", "valeur")


def stop_details(d: DocViews) -> DataFrame:
    """Every stop with its last CO2 / noise / temperature reading (NULL
    when none), display name fallback and marker colour (> 400 orange,
    > 500 red, missing counts as 0)."""
    s = d.stops.join(_sensor_means(d, with_db_test=False), "id_arret", "left")
    co2 = F.coalesce(nan_to_null("co2"), F.lit(0.0))
    return s.select(
        "id_arret",
        F.coalesce(F.when(F.col("nom") != "", F.col("nom")), F.lit(NAMELESS_STOP)).alias("nom"),
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("id_ligne").alias("ligne"),
        nan_to_null("co2").alias("co2"), nan_to_null("bruit").alias("bruit"), nan_to_null("temp").alias("temp"),
        F.when(co2 > 500, "red").when(co2 > 400, "orange").otherwise("green").alias("couleur"),
        *[_reading_text(c).alias(f"{c}_txt") for c in ("co2", "bruit", "temp")])


def _reading_text(c: str):
    """Popup text of a reading: one decimal, or N/A when missing."""
    v = nan_to_null(c)
    return F.coalesce(F.format_string("%.1f", F.round(v, 1)), F.lit("N/A"))


def co2_by_quartier(d: DocViews) -> DataFrame:
    """Mean CO2 per district (id, name), highest first. Measures are
    reduced per stop, then spread over the stop's districts."""
    sensors = d.sensors.filter(F.col("type_capteur").rlike("(?i)CO2")).select("id_capteur", "id_arret")
    per_stop = d.measures.select("id_capteur", "valeur").join(sensors, "id_capteur").groupBy("id_arret").agg(
        F.sum("valeur").alias("s"), F.count(F.lit(1)).alias("n"))
    return (per_stop.join(d.stop_districts, "id_arret")
            .groupBy("id_quartier", F.col("quartier_nom").alias("nom_quartier"))
            .agg((F.sum("s") / F.sum("n")).alias("avg_co2"))
            .orderBy(F.when(~F.isnan("avg_co2"), F.col("avg_co2")).desc_nulls_last(), "id_quartier")
            .select("id_quartier", "nom_quartier", nan_to_null("avg_co2").alias("avg_co2")))


def quartier_features(d: DocViews, quartiers: DataFrame) -> DataFrame:
    """District layer: every district document with its mean CO2
    (0 when unknown, 2 decimals) and full name (D9 name, else its own)."""
    co2 = co2_by_quartier(d)
    return (quartiers.join(co2, "id_quartier", "left")
            .select("id_quartier", "nom", F.round(F.coalesce("avg_co2", F.lit(0.0)), 2).alias("avg_co2"),
                    F.coalesce("nom_quartier", "nom").alias("nom_complet"), "geometry")
            .orderBy("id_quartier"))


def feature_collection_lines(features: DataFrame) -> DataFrame:
    """D10 sink form: one GeoJSON Feature per line (JSON-lines), built by
    ``to_json`` on the executors; concatenating the lines inside a
    FeatureCollection envelope gives the map layer."""
    feat = F.struct(
        F.lit("Feature").alias("type"), F.col("id_quartier").alias("id"),
        F.struct("id_quartier", "nom", "avg_co2", "nom_complet").alias("properties"),
        F.col("geometry").alias("geometry"))
    return features.select("id_quartier", F.to_json(feat).alias("feature"))


# --- D11–D20: figures over the document-profile results ----------------------

def noise_axis(e: DataFrame) -> DataFrame:
    """Y-axis range of the noisiest-districts chart."""
    return e.agg((F.min("avg_bruit") * 0.98).alias("y_min"), (F.max("avg_bruit") * 1.01).alias("y_max"))


def temp_extremes(j: DataFrame, k: int = 10) -> DataFrame:
    """The k warmest then the k coldest lines (the same line can be in
    both when there are fewer than 2k lines). Missing means sort after
    every value, so they fall into the cold tail. One pass over the report:
    each line is tagged for both groups and ranked inside its group (the
    window holds one row per line)."""
    from pyspark.sql import Window
    v, top = F.col("avg_temperature"), F.col("groupe") == "top"
    tagged = j.select("nom_ligne", "avg_temperature",
                      F.explode(F.array(F.lit("top"), F.lit("bottom"))).alias("groupe"))
    w = Window.partitionBy("groupe").orderBy(
        F.when(top, v.isNull()).otherwise(v.isNotNull()).asc(),
        F.when(top, -v).otherwise(v).asc(),
        F.when(top, F.col("nom_ligne")).asc(),
        F.when(~top, F.col("nom_ligne")).desc())
    return (tagged.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
            .orderBy(F.col("groupe").desc(), "_r").drop("_r"))


def temp_bounds(extremes: DataFrame) -> DataFrame:
    return extremes.agg((F.min("avg_temperature") * 0.99).alias("y_min"),
                        (F.max("avg_temperature") * 1.01).alias("y_max"))


def worst_lines(a: DataFrame, k: int = 15) -> DataFrame:
    """The k highest mean delays."""
    return a.orderBy(F.col("avg_retard").desc_nulls_last(), "nom_ligne").limit(k)


def drivers_ranked(kdf: DataFrame, k: int = 10, ascending: bool = True) -> DataFrame:
    """First k drivers by mean delay. The dashboard sorts ascending
    although its title announces the highest delays; ``ascending`` keeps
    that default."""
    v = F.col("avg_retard_minutes")
    return kdf.orderBy(v.asc_nulls_last() if ascending else v.desc_nulls_last(), "chauffeur_nom").limit(k)


def drivers_bounds(top: DataFrame) -> DataFrame:
    return top.agg((F.min("avg_retard_minutes") * 0.90).alias("y_min"),
                   (F.max("avg_retard_minutes") * 1.05).alias("y_max"))


def co2_histogram(ddf: DataFrame, bins: int = 20) -> DataFrame:
    """Histogram of mean CO2 per vehicle, split by vehicle type, over
    ``bins`` equal-width bins spanning the global range. One lazy plan: the range is a
    scalar subquery of it, nothing runs while the frame is built."""
    rows_ = ddf.select("type_vehicule", "avg_co2").where(F.col("avg_co2").isNotNull())
    bounds = rows_.agg(F.struct(F.min("avg_co2").alias("lo"), F.max("avg_co2").alias("hi")).alias("b")).scalar()
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    width = F.when(hi > lo, (hi - lo) / bins).otherwise(1.0)
    b = F.least(F.floor((F.col("avg_co2") - lo) / width).cast("int"), F.lit(bins - 1))
    return (rows_.withColumn("_b", bounds)
            .groupBy("type_vehicule", b.alias("bin"), lo.alias("_lo"), width.alias("_w")).agg(F.count(F.lit(1)).alias("n"))
            .select("type_vehicule", "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"),
                    (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("bin_end"), "n")
            .orderBy("type_vehicule", "bin"))


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Counts per value, NULL dropped, most frequent first."""
    return (df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.desc(name), column))


def delay_class_counts(n: DataFrame) -> DataFrame:
    """Lines per delay class (pie chart)."""
    return value_counts(n, "classification_retard", "nb_lignes")


def daily_passengers(b: DataFrame) -> DataFrame:
    """Mean over lines of the per-line daily mean passengers."""
    return (b.filter(F.col("jour").isNotNull()).groupBy("jour")
            .agg(F.avg("avg_passagers").alias("avg_passagers")).orderBy("jour"))


def electric_ranked(l_: DataFrame) -> DataFrame:
    """Electric share, highest first."""
    return l_.orderBy(F.col("taux_electrique").desc_nulls_last(), "nom_ligne")


def corr_ranked(i: DataFrame) -> DataFrame:
    """Correlation, lowest first."""
    return i.orderBy(F.col("correlation").asc_nulls_last(), "nom_ligne")


def incident_scatter(c: DataFrame) -> DataFrame:
    """Incident rate per line, as reported."""
    return c.select("nom_ligne", "incident_taux")


def punctuality_pct(g: DataFrame) -> DataFrame:
    """Punctuality in percent and as the banner text (2 decimals)."""
    pct = F.col("taux_sans_retard") * 100
    return g.select(pct.alias("ponctualite_pct"),
                    F.format_string("%.2f%%", F.round(pct, 2)).alias("ponctualite_txt"))


def selection_mix(board: DataFrame) -> DataFrame:
    """Vehicle-type mix of the current board selection."""
    return value_counts(board, "type_vehicule", "nombre")


# --- convenience: products computed from the document reports ----------------

def doc_report(d: DocViews, letter: str) -> DataFrame:
    return reports_doc.REPORTS[letter](d)
