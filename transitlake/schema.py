"""Schemas: the 11 relational tables, the 5 document collections and the
column contracts of the 14 report outputs."""

from __future__ import annotations

from pyspark.sql import types as T

L, S, D, TS, DT, B, I = (T.LongType(), T.StringType(), T.DoubleType(),
                         T.TimestampNTZType(), T.DateType(), T.BooleanType(), T.IntegerType())


def _st(*fields, pk: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(n, t, n not in pk) for n, t in fields])


# --- relational tables (primary key columns non-nullable) -------------------
LIGNE = _st(("id_ligne", L), ("nom_ligne", S), ("type", S), ("frequentation_moyenne", L), pk=("id_ligne",))
QUARTIER = _st(("id_quartier", L), ("nom", S), ("geojson", S), pk=("id_quartier",))
ARRET = _st(("id_arret", L), ("nom", S), ("latitude", D), ("longitude", D), ("id_ligne", L), pk=("id_arret",))
ARRET_QUARTIER = _st(("id_arret", L), ("id_quartier", L), pk=("id_arret", "id_quartier"))
CHAUFFEUR = _st(("id_chauffeur", L), ("nom", S), ("date_embauche", DT), pk=("id_chauffeur",))
VEHICULE = _st(("id_vehicule", L), ("immatriculation", S), ("id_ligne", L), ("id_chauffeur", L),
               ("type_vehicule", S), ("capacite", L), pk=("id_vehicule",))
HORAIRE = _st(("id_horaire", L), ("id_arret", L), ("id_vehicule", L), ("heure_prevue", TS),
              ("heure_effective", TS), ("passagers_estimes", L), pk=("id_horaire",))
CAPTEUR = _st(("id_capteur", L), ("id_arret", L), ("type_capteur", S), ("latitude", D), ("longitude", D),
              pk=("id_capteur",))
# Mesure carries no id on the driver bindings (FIXTURES: the natural key repeats).
MESURE = _st(("id_capteur", L), ("horodatage", TS), ("valeur", D), ("unite", S))
TRAFIC = _st(("id_trafic", L), ("id_ligne", L), ("horodatage", TS), ("retard_minutes", L), ("evenement", S),
             pk=("id_trafic",))
INCIDENT = _st(("id_incident", L), ("id_trafic", L), ("description", S), ("gravite", L), ("horodatage", TS))

TABLES: dict[str, T.StructType] = {
    "Ligne": LIGNE, "Quartier": QUARTIER, "Arret": ARRET, "ArretQuartier": ARRET_QUARTIER,
    "Chauffeur": CHAUFFEUR, "Vehicule": VEHICULE, "Horaire": HORAIRE, "Capteur": CAPTEUR,
    "Mesure": MESURE, "Trafic": TRAFIC, "Incident": INCIDENT,
}

PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "Ligne": ("id_ligne",), "Quartier": ("id_quartier",), "Arret": ("id_arret",),
    "ArretQuartier": ("id_arret", "id_quartier"), "Chauffeur": ("id_chauffeur",),
    "Vehicule": ("id_vehicule",), "Horaire": ("id_horaire",), "Capteur": ("id_capteur",),
    "Mesure": (), "Trafic": ("id_trafic",), "Incident": ("id_incident",),
}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("Arret", "id_ligne", "Ligne", "id_ligne"),
    ("ArretQuartier", "id_quartier", "Quartier", "id_quartier"),
    ("ArretQuartier", "id_arret", "Arret", "id_arret"),
    ("Vehicule", "id_chauffeur", "Chauffeur", "id_chauffeur"),
    ("Vehicule", "id_ligne", "Ligne", "id_ligne"),
    ("Horaire", "id_vehicule", "Vehicule", "id_vehicule"),
    ("Horaire", "id_arret", "Arret", "id_arret"),
    ("Capteur", "id_arret", "Arret", "id_arret"),
    ("Mesure", "id_capteur", "Capteur", "id_capteur"),
    ("Trafic", "id_ligne", "Ligne", "id_ligne"),
    ("Incident", "id_trafic", "Trafic", "id_trafic"),
]

# --- document collections ----------------------------------------------------
POINT = T.StructType([T.StructField("type", S), T.StructField("coordinates", T.ArrayType(D))])
POLYGON = T.StructType([T.StructField("type", S),
                        T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(D))))])

MESURE_DOC = _st(("horodatage", TS), ("valeur", D), ("unite", S))
CAPTEUR_DOC = T.StructType([
    T.StructField("id_capteur", L), T.StructField("type_capteur", S), T.StructField("location", POINT),
    T.StructField("mesures", T.ArrayType(MESURE_DOC)),
])
HORAIRE_DOC = _st(("id_vehicule", L), ("heure_prevue", S), ("heure_effective", S), ("passagers_estimes", D))
QUARTIER_REF = _st(("id_quartier", L), ("nom", S))

ARRETS = T.StructType([
    T.StructField("id_arret", L), T.StructField("nom", S), T.StructField("id_ligne", L),
    T.StructField("location", POINT), T.StructField("latitude", D), T.StructField("longitude", D),
    T.StructField("quartiers", T.ArrayType(QUARTIER_REF)),
    T.StructField("capteurs", T.ArrayType(CAPTEUR_DOC)),
    T.StructField("horaires", T.ArrayType(HORAIRE_DOC)),
])
CHAUFFEUR_DOC = _st(("id_chauffeur", L), ("nom", S), ("date_embauche", DT))
VEHICULES = T.StructType([
    T.StructField("id_vehicule", L), T.StructField("immatriculation", S), T.StructField("id_ligne", L),
    T.StructField("type_vehicule", S), T.StructField("capacite", L), T.StructField("chauffeur", CHAUFFEUR_DOC),
])
INCIDENT_DOC = _st(("description", S), ("gravite", L), ("horodatage", TS))
TRAFIC_DOC = T.StructType([
    T.StructField("id_trafic", L), T.StructField("id_ligne", L), T.StructField("horodatage", TS),
    T.StructField("retard_minutes", L), T.StructField("evenement", S),
    T.StructField("incidents", T.ArrayType(INCIDENT_DOC)),
])
QUARTIERS = T.StructType([
    T.StructField("id_quartier", L), T.StructField("nom", S), T.StructField("nom_officiel", S),
    T.StructField("code_quartier", S), T.StructField("arrondissement", I), T.StructField("geometry", POLYGON),
    T.StructField("surface", D), T.StructField("perimetre", D), T.StructField("is_real_paris", B),
])

# --- report output contracts (column order of the CSV files) -----------------
REPORT_COLUMNS: dict[str, list[tuple[str, T.DataType]]] = {
    "a": [("nom_ligne", S), ("avg_retard", D)],
    "b": [("nom_ligne", S), ("jour", S), ("avg_passagers", D)],
    "c": [("nom_ligne", S), ("incident_taux", D)],
    "d": [("immatriculation", S), ("type_vehicule", S), ("avg_co2", D)],
    "e": [("quartier_nom", S), ("avg_bruit", D)],
    "f": [("nom_ligne", S)],
    "g": [("taux_sans_retard", D)],
    "h": [("quartier_nom", S), ("arret_count", L)],
    "i": [("nom_ligne", S), ("correlation", D)],
    "j": [("nom_ligne", S), ("avg_temperature", D)],
    "k": [("chauffeur_nom", S), ("avg_retard_minutes", D)],
    "l": [("nom_ligne", S), ("taux_electrique", D)],
    "m": [("id_capteur", L), ("latitude", D), ("longitude", D), ("valeur", D), ("niveau_pollution", S)],
    "n": [("nom_ligne", S), ("classification_retard", S)],
}


def contract_schema(report: str) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in REPORT_COLUMNS[report]])
