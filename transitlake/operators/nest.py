"""Nest jobs: relational tables → document collections (M1–M4) and their
load statistics (M7).

A child list can be arbitrarily long (one sensor may own a third of all measures), so a parent is
stored as one or more documents, ``part`` 0, 1, ...: part p holds the children at positions
[p * max_items, (p + 1) * max_items) in order, and every part repeats the parent's fields.
A stop's document holds at most ``max_items`` measures (a sensor without measures counts as one),
``max_items`` timetable rows and ``max_items`` districts, whatever the skew; a parent whose lists all fit is
exactly one document. Only the parents with more children than that (``crowded``, found by a count of the keys) need positions:
theirs are numbered (``with_position``, a range partitioning that splits a hot parent over many tasks) and grouped by
(parent, part), so the parts of a hot parent land in different tasks. The lists of all others are grouped by the parent alone.
``DocViews.from_collections`` unwinds either form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.operators.docviews import TS_TEXT
from transitlake.operators.positional import with_position
from transitlake.session import stored
from transitlake.sources.binding import Network
from transitlake.sources.collections import LoadCounts

DEFAULT_MAX_ITEMS = 50_000
BUCKETS = 1 << 16


def required(name: str, job: str) -> Column:
    """The column, failing the job where it is NULL: the document form cannot hold it. The check rides
    on the pass that builds the documents."""
    problem = F.raise_error(F.lit(f"{job}: NULL in {name}; the document form cannot hold it"))
    return F.when(F.col(name).isNull(), problem).otherwise(F.col(name)).alias(name)


def _unless_empty(df: DataFrame, name: str) -> DataFrame | None:
    df = stored(df, name)
    return None if df.isEmpty() else df


def crowded(rows: DataFrame, key: str, max_items: int, counts: LoadCounts | None = None, name: str = "") -> DataFrame | None:
    """The keys that more than ``max_items`` rows have; None without such keys. A key with that many rows fills its hash bucket
    as far, so rows are counted by bucket, and by key only in the buckets that hold more. ``counts`` takes the rows with a key as ``name``."""
    rows = rows.filter(F.col(key).isNotNull()).select(key, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_b"))
    buckets = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    if counts is not None:
        buckets = counts.watch(buckets, weight=F.col("_n"), **{name: F.lit(True)})
    full = _unless_empty(buckets.filter(F.col("_n") > max_items), "buckets")
    if full is None:
        return None
    by_key = rows.join(full.select("_b"), "_b", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return _unless_empty(by_key.filter(F.col("_n") > max_items).select(key), "crowded")


def _split(df: DataFrame, key: str, large: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of all parents but the ``large`` ones, and rows of those."""
    return (df, None) if large is None else (df.join(large, key, "left_anti"), df.join(large, key, "left_semi"))


def in_parts(df: DataFrame, key: str, order: list[str], max_items: int) -> DataFrame:
    """``df`` with ``part``, the run of ``max_items`` children that a row falls in; rows without a key belong to no parent."""
    rows = with_position(df.filter(F.col(key).isNotNull()), [key], order)
    return rows.withColumn("part", F.floor(F.col("pos") / max_items)).drop("pos")


def lists(df: DataFrame, keys: list[str], order: list[str], item: Column, name: str) -> DataFrame:
    """(keys, name): children of each parent, or of each part of it, in ``order``."""
    sort = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)]).alias("_o")
    return (df.filter(F.col(keys[0]).isNotNull()).groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct(sort, item.alias("_i")))).alias("_l"))
            .select(*keys, F.transform("_l", lambda x: x["_i"]).alias(name)))


def _point(lon: str, lat: str) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))


def nest_lignes(net: Network) -> DataFrame:
    """M1: the line collection is a copy of the table."""
    return net.Ligne


SENSOR_ORDER = ["id_capteur", "horodatage", "valeur", "unite"]


def _sensor_rows(capteur: DataFrame, mesure: DataFrame) -> DataFrame:
    return capteur.filter(F.col("id_arret").isNotNull()).join(mesure.withColumn("present", F.lit(True)), "id_capteur", "left")


def _sensors(rows: DataFrame, keys: list[str]) -> DataFrame:
    measure = F.when(F.col("present"), F.struct("horodatage", F.coalesce(F.col("valeur"), F.lit(float("nan"))).alias("valeur"),
                                                "unite"))
    entry = F.struct("id_capteur", "type_capteur", _point("longitude", "latitude").alias("location"), "mesures")
    return (rows.groupBy(*keys, "id_capteur", "type_capteur", "longitude", "latitude")
            .agg(F.sort_array(F.collect_list(measure)).alias("mesures"))
            .groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("capteurs")))


def sensor_lists(net: Network, max_items: int) -> DataFrame:
    """(id_arret, part, capteurs): sensors in id order, each with its measures of the part in time order."""
    return _sensors(in_parts(_sensor_rows(net.Capteur, net.Mesure), "id_arret", SENSOR_ORDER, max_items), ["id_arret", "part"])


def _sensor_sizes(net: Network, counts: LoadCounts | None) -> DataFrame:
    """(id_capteur, _n): measures of each sensor. ``counts`` takes the measures read, orphans included; where a sensor's row repeats, so
    do its measures, as in the lists."""
    sizes = net.Mesure.groupBy("id_capteur").agg(F.count(F.lit(1)).alias("_n"))
    if counts is not None:
        copies = net.Capteur.filter(F.col("id_arret").isNotNull()).groupBy("id_capteur").agg(F.count(F.lit(1)).alias("_copies"))
        read = F.col("_n") * F.coalesce(F.col("_copies"), F.lit(1))
        sizes = counts.watch(sizes.join(copies, "id_capteur", "left"), weight=read, mesures=F.col("id_capteur").isNotNull())
    return stored(sizes.select("id_capteur", "_n"), "measures")


def _crowded_by_measures(net: Network, sizes: DataFrame, max_items: int) -> DataFrame | None:
    caps = net.Capteur.filter(F.col("id_arret").isNotNull()).select("id_capteur", "id_arret")
    own = F.coalesce(F.col("_n"), F.lit(1))  # a sensor without measures counts as one
    by_stop = caps.join(sizes, "id_capteur", "left").groupBy("id_arret").agg(F.sum(own).alias("_n"))
    return _unless_empty(by_stop.filter(F.col("_n") > max_items).select("id_arret"), "crowded")


def nest_arrets(net: Network, max_items: int = DEFAULT_MAX_ITEMS, validate: bool = True, counts: LoadCounts | None = None) -> DataFrame:
    """M2: stop documents with location, districts, sensors (+ measures) and
    timetable. Missing lists are empty; NULL passenger counts become NaN and
    timetable times stay text, as in the reference's documents. ``counts`` takes the measures read (M7)."""
    h_item = F.struct(F.col("id_vehicule"), F.date_format("heure_prevue", TS_TEXT).alias("heure_prevue"),
                      F.date_format("heure_effective", TS_TEXT).alias("heure_effective"),
                      F.coalesce(F.col("passagers_estimes").cast("double"), F.lit(float("nan")))
                      .alias("passagers_estimes"))
    q_item = F.struct("id_quartier", "nom")
    bridge = net.ArretQuartier.join(net.Quartier.select("id_quartier", "nom"), "id_quartier")
    key, of_part, q_order = ["id_arret"], ["id_arret", "part"], ["id_quartier", "nom"]
    sizes, mesure = _sensor_sizes(net, counts), net.Mesure
    found = [x for x in (_crowded_by_measures(net, sizes, max_items), crowded(net.Horaire, "id_arret", max_items),
                         crowded(bridge, "id_arret", max_items)) if x is not None]
    large = stored(reduce(DataFrame.union, found).distinct(), "large") if found else None
    (stops, l_stops), (caps, l_caps), (times, l_times), (districts, l_districts) = [
        _split(df, "id_arret", large) for df in (net.Arret, net.Capteur, net.Horaire, bridge)]
    if large is not None:  # stops of a sensor with that many measures are large, so no other list holds them
        mesure = mesure.join(sizes.filter(F.col("_n") > max_items).select("id_capteur"), "id_capteur", "left_anti")
    docs = (stops.join(_sensors(_sensor_rows(caps, mesure), key), key, "left")
            .join(lists(times, key, ["id_horaire"], h_item, "horaires"), key, "left")
            .join(lists(districts, key, q_order, q_item, "quartiers"), key, "left").withColumn("part", F.lit(0).cast("long")))
    if large is not None:
        parts = (_sensors(in_parts(_sensor_rows(l_caps, net.Mesure), "id_arret", SENSOR_ORDER, max_items), of_part)
                 .join(lists(in_parts(l_times, "id_arret", ["id_horaire"], max_items), of_part, ["id_horaire"], h_item, "horaires"), of_part, "full")
                 .join(lists(in_parts(l_districts, "id_arret", q_order, max_items), of_part, q_order, q_item, "quartiers"), of_part, "full"))
        docs = docs.unionByName(l_stops.join(parts, "id_arret", "left"))

    def listed(name: str) -> Column:
        return F.coalesce(name, F.array().cast(S.ARRETS[name].dataType)).alias(name)

    return docs.select(
        "id_arret", F.coalesce("part", F.lit(0)).cast("long").alias("part"), "nom",
        required("id_ligne", "nest_arrets") if validate else F.col("id_ligne"),
        _point("longitude", "latitude").alias("location"), "latitude", "longitude",
        listed("quartiers"), listed("capteurs"), listed("horaires"))


def nest_vehicules(net: Network, validate: bool = True) -> DataFrame:
    """M3: vehicles with their driver as a sub-document (left join; a driver id that repeats fails the job, J8)."""
    drv = net.Chauffeur.groupBy(F.col("id_chauffeur").alias("c_id")).agg(
        F.max("nom").alias("c_nom"), F.max("date_embauche").alias("date_embauche"), F.count(F.lit(1)).alias("c_n"))
    v = net.Vehicule.join(drv, F.col("id_chauffeur") == F.col("c_id"), "left")
    name = F.col("c_nom")
    if validate:
        repeats = F.raise_error(F.lit("nest_vehicules: key id_chauffeur repeats in the right-hand table (many-to-one expected)"))
        name = F.when(F.col("c_n") > 1, repeats).otherwise(name)
    own = [required(c, "nest_vehicules") if validate else F.col(c) for c in ("id_ligne", "capacite", "id_chauffeur")]
    return v.select("id_vehicule", "immatriculation", own[0], "type_vehicule", own[1],
                    F.struct(own[2], name.alias("nom"), F.col("date_embauche")).alias("chauffeur"))


def nest_trafic(net: Network, max_items: int = DEFAULT_MAX_ITEMS, validate: bool = True, counts: LoadCounts | None = None) -> DataFrame:
    """M4: traffic rows with their incidents (empty list when none). ``counts`` takes the incidents read (M7)."""
    item = F.struct("description", "gravite", "horodatage")
    order = ["horodatage", "id_incident", "description", "gravite"]
    large = crowded(net.Incident, "id_trafic", max_items, counts, "incidents")
    (trafic, l_trafic), (inc, l_inc) = [_split(df, "id_trafic", large) for df in (net.Trafic, net.Incident)]
    docs = (trafic.join(lists(inc, ["id_trafic"], order, item, "incidents"), "id_trafic", "left")
            .withColumn("part", F.lit(0).cast("long")))
    if large is not None:
        parts = lists(in_parts(l_inc, "id_trafic", order, max_items), ["id_trafic", "part"], order, item, "incidents")
        docs = docs.unionByName(l_trafic.join(parts, "id_trafic", "left"))
    line, delay = [required(c, "nest_trafic") if validate else F.col(c) for c in ("id_ligne", "retard_minutes")]
    return docs.select("id_trafic", F.coalesce("part", F.lit(0)).cast("long").alias("part"), line, "horodatage", delay, "evenement",
                       F.coalesce("incidents", F.array().cast(S.TRAFIC_DOC["incidents"].dataType))
                       .alias("incidents"))


def load_statistics(net: Network, quartiers: DataFrame | None = None) -> DataFrame:
    """M7: rows per collection, by a scan of every table (``plans.export`` counts while it writes). Measures and incidents are counted
    before they are attached (orphans included), as the reference's summary does."""
    counted = {"lignes": net.Ligne, "arrets": net.Arret, "vehicules": net.Vehicule, "trafic": net.Trafic,
               "mesures": net.Mesure.filter(F.col("id_capteur").isNotNull()),
               "incidents": net.Incident.filter(F.col("id_trafic").isNotNull())}
    if quartiers is not None:
        counted |= {"quartiers": quartiers, "quartiers_reels": quartiers.filter(F.col("is_real_paris"))}
    out = None
    for name, rows in counted.items():
        one = rows.agg(F.lit(name).alias("collection"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
