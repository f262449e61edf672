"""The document profile in unwound form.

The document reports of the reference unwind nested arrays (stop → sensors
→ measures, stop → districts, stop → timetable, traffic → incidents). What
an unwind returns is fixed by how the documents were built: a child belongs
to a document only if its parent key matches (inner join), NULL numbers are
stored as NaN, and a missing list is empty. ``DocViews`` holds exactly those
unwound rows, built either

* from the relational tables (``from_network``): joins that mirror the
  nesting, no arrays materialised, so hot stops or sensors never become one
  giant value; or
* from nested collections (``from_collections``): ``explode`` of the stored
  arrays (the output of the nest jobs in ``operators.nest``).

Both give the same rows (tests/test_nest.py). Reports in the document profile
only ever consume DocViews, and they reduce ``measures`` per sensor before
joining it to ``sensors``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.functions.calc import null_to_nan
from transitlake.sources.binding import Later, Network, OnDemand

TS_TEXT = "yyyy-MM-dd HH:mm:ss"


@dataclass
class DocViews(OnDemand):
    lignes: DataFrame          # id_ligne, nom_ligne, type, frequentation_moyenne
    stops: DataFrame           # id_arret, nom, id_ligne, latitude, longitude
    stop_districts: DataFrame  # id_arret, id_ligne, id_quartier, quartier_nom
    sensors: DataFrame         # id_arret, nom, id_ligne, latitude, longitude, id_capteur, type_capteur, cap_latitude, cap_longitude
    measures: DataFrame        # id_capteur, horodatage, valeur (NaN for missing), unite
    timetable: DataFrame       # id_arret, id_vehicule, heure_prevue (text), heure_effective (text), passagers_estimes (NaN for missing)
    vehicles: DataFrame        # id_vehicule, immatriculation, id_ligne, type_vehicule, capacite, id_chauffeur, chauffeur_nom, date_embauche
    traffic: DataFrame         # id_trafic, id_ligne, horodatage, retard_minutes, evenement, n_incidents
    incidents: DataFrame       # id_trafic, description, gravite, horodatage (attached ones only)

    @staticmethod
    def from_network(net: Network) -> "DocViews":
        """The views of the tables; each is built when a report first reads it."""
        return DocViews(**{name: Later(lambda view=view: view(net)) for name, view in NETWORK_VIEWS.items()})

    @staticmethod
    def from_collections(lignes: DataFrame, arrets: DataFrame, vehicules: DataFrame,
                         trafic: DataFrame) -> "DocViews":
        """Unwind stored collections (nested parquet written by the nest jobs).

        Documents split into overflow parts (``part`` > 0, see
        ``operators.nest``) repeat the parent fields and carry further children:
        parent-level views read part 0, child-level views read every part.
        The stored arrays are exploded, never collected.
        """
        return DocViews(lignes=lignes, **arret_views(arrets), **vehicule_views(vehicules), **trafic_views(trafic))


def _stops(net: Network) -> DataFrame:
    return net.Arret.select("id_arret", "nom", "id_ligne", "latitude", "longitude")


def _stop_districts(net: Network) -> DataFrame:
    return (net.ArretQuartier.join(net.Quartier.select("id_quartier", F.col("nom").alias("quartier_nom")), "id_quartier")
            .join(net.Arret.select("id_arret", "id_ligne"), "id_arret")
            .select("id_arret", "id_ligne", "id_quartier", "quartier_nom"))


def _sensors(net: Network) -> DataFrame:
    own = net.Capteur.select("id_capteur", "id_arret", "type_capteur", F.col("latitude").alias("cap_latitude"),
                             F.col("longitude").alias("cap_longitude"))
    return own.join(_stops(net), "id_arret").select("id_arret", "nom", "id_ligne", "latitude", "longitude", "id_capteur",
                                                    "type_capteur", "cap_latitude", "cap_longitude")


def _measures(net: Network) -> DataFrame:
    return net.Mesure.select("id_capteur", "horodatage", null_to_nan("valeur").alias("valeur"), "unite")


def _timetable(net: Network) -> DataFrame:
    return net.Horaire.select(
        "id_arret", "id_vehicule",
        F.date_format("heure_prevue", TS_TEXT).alias("heure_prevue"),
        F.date_format("heure_effective", TS_TEXT).alias("heure_effective"),
        null_to_nan("passagers_estimes").alias("passagers_estimes"))


def _vehicles(net: Network) -> DataFrame:
    chauffeur = net.Chauffeur.select("id_chauffeur", F.col("nom").alias("chauffeur_nom"), "date_embauche")
    return net.Vehicule.join(chauffeur, "id_chauffeur", "left").select(
        "id_vehicule", "immatriculation", "id_ligne", "type_vehicule", "capacite", "id_chauffeur", "chauffeur_nom", "date_embauche")


def _traffic(net: Network) -> DataFrame:
    counts = net.Incident.filter(F.col("id_trafic").isNotNull()).groupBy("id_trafic").agg(F.count(F.lit(1)).alias("n_incidents"))
    return (net.Trafic.join(counts, "id_trafic", "left")
            .select("id_trafic", "id_ligne", "horodatage", "retard_minutes", "evenement",
                    F.coalesce("n_incidents", F.lit(0)).alias("n_incidents")))


def _incidents(net: Network) -> DataFrame:
    return net.Incident.join(net.Trafic.select("id_trafic").distinct(), "id_trafic", "left_semi") \
        .select("id_trafic", "description", "gravite", "horodatage")


NETWORK_VIEWS = {"lignes": lambda net: net.Ligne, "stops": _stops, "stop_districts": _stop_districts, "sensors": _sensors,
                 "measures": _measures, "timetable": _timetable, "vehicles": _vehicles, "traffic": _traffic, "incidents": _incidents}


def _head(df: DataFrame) -> DataFrame:
    return df.filter(F.col("part") == 0) if "part" in df.columns else df


def arret_views(arrets: DataFrame) -> dict[str, DataFrame]:
    """The views that unwind the stop collection."""
    coords = F.col("location.coordinates")
    stops = _head(arrets).select("id_arret", "nom", "id_ligne", F.get(coords, 1).alias("latitude"),
                                F.get(coords, 0).alias("longitude"))
    # every child sits in exactly one part; parent fields repeat in each part
    districts = arrets.select("id_arret", "id_ligne", F.explode("quartiers").alias("q")).select(
        "id_arret", "id_ligne", F.col("q.id_quartier").alias("id_quartier"), F.col("q.nom").alias("quartier_nom"))
    cap = arrets.select("id_arret", "nom", "id_ligne", F.get(coords, 1).alias("latitude"),
                        F.get(coords, 0).alias("longitude"), F.explode("capteurs").alias("c"))
    sensors = cap.select("id_arret", "nom", "id_ligne", "latitude", "longitude",
                         F.col("c.id_capteur").alias("id_capteur"), F.col("c.type_capteur").alias("type_capteur"),
                         F.get(F.col("c.location.coordinates"), 1).alias("cap_latitude"),
                         F.get(F.col("c.location.coordinates"), 0).alias("cap_longitude"))
    if "part" in arrets.columns:  # a sensor has an entry in each part that holds measures of it
        sensors = sensors.distinct()
    measures = (cap.select(F.col("c.id_capteur").alias("id_capteur"), F.explode("c.mesures").alias("m"))
                .select("id_capteur", F.col("m.horodatage").alias("horodatage"),
                        F.col("m.valeur").alias("valeur"), F.col("m.unite").alias("unite")))
    timetable = (arrets.select("id_arret", F.explode("horaires").alias("h"))
                 .select("id_arret", "h.id_vehicule", "h.heure_prevue", "h.heure_effective",
                         "h.passagers_estimes"))
    return {"stops": stops, "stop_districts": districts, "sensors": sensors, "measures": measures, "timetable": timetable}


def vehicule_views(vehicules: DataFrame) -> dict[str, DataFrame]:
    vehicles = vehicules.select("id_vehicule", "immatriculation", "id_ligne", "type_vehicule", "capacite",
                                F.col("chauffeur.id_chauffeur").alias("id_chauffeur"),
                                F.col("chauffeur.nom").alias("chauffeur_nom"),
                                F.col("chauffeur.date_embauche").alias("date_embauche"))
    return {"vehicles": vehicles}


def trafic_views(trafic: DataFrame) -> dict[str, DataFrame]:
    """``n_incidents`` is the size of the stored array: NULL where the array is missing."""
    n_inc = F.when(F.col("incidents").isNotNull(), F.size("incidents")).cast("long")
    base = ["id_trafic", "id_ligne", "horodatage", "retard_minutes", "evenement"]
    if "part" in trafic.columns:
        sizes = trafic.groupBy("id_trafic").agg(F.sum(n_inc).alias("n_incidents"))
        traffic = _head(trafic).select(*base).join(sizes, "id_trafic").select(*base, "n_incidents")
    else:
        traffic = trafic.select(*base, n_inc.alias("n_incidents"))
    incidents = trafic.select("id_trafic", F.explode("incidents").alias("i")).select(
        "id_trafic", "i.description", "i.gravite", "i.horodatage")
    return {"traffic": traffic, "incidents": incidents}
