"""DuckDB twins of the dashboard products, nest/district jobs, the
positional variant W1 and the quality checks (see oracle_twins.py)."""

from __future__ import annotations

from oracle_twins import DOC, RAW_DOC, RAW_REL, REL, doc_avg as _doc_avg, rounded as _rr
from transitlake import schema as S
from transitlake.plans.catalog import OTHER_TYPE


def _cls_case(with_db: bool) -> str:
    noise = "contains(type_capteur, 'Bruit')" + (" OR contains(lower(type_capteur), 'db')" if with_db else "")
    return (f"CASE WHEN contains(type_capteur, 'CO2') THEN 'co2' WHEN {noise} THEN 'bruit' "
            f"WHEN contains(type_capteur, 'Temp') THEN 'temp' END")


def _per_stop(with_db: bool) -> str:
    return f"""SELECT id_arret,
        arg_max(avg, id_capteur) FILTER (WHERE cls = 'co2') AS co2,
        arg_max(avg, id_capteur) FILTER (WHERE cls = 'bruit') AS bruit,
        arg_max(avg, id_capteur) FILTER (WHERE cls = 'temp') AS temp
    FROM (SELECT Capteur.id_arret, Capteur.id_capteur, {_cls_case(with_db)} AS cls,
                 {_doc_avg('valeur')} AS avg
          FROM Arret JOIN Capteur ON Capteur.id_arret = Arret.id_arret
              JOIN Mesure ON Mesure.id_capteur = Capteur.id_capteur
          GROUP BY Capteur.id_arret, Capteur.id_capteur, type_capteur) s
    GROUP BY id_arret"""


LVM = "SELECT id_ligne, arg_min(type_vehicule, id_vehicule) AS v_type FROM Vehicule GROUP BY id_ligne"


def board_sql(id_ligne=None, vehicle_type=None, co2_level="all") -> str:
    """The stop board as a SELECT (no rounding beyond its own)."""
    cond = ["TRUE"]
    if vehicle_type is not None:
        cond.append(f"Arret.id_ligne IN (SELECT id_ligne FROM ({LVM}) l WHERE v_type = '{vehicle_type}')")
    if id_ligne is not None:
        cond.append(f"Arret.id_ligne = {int(id_ligne)}")
    co2 = "COALESCE(ps.co2, 0.0)"
    level = {"all": "TRUE", "low": f"(isnan({co2}) OR {co2} <= 400)",
             "medium": f"(NOT isnan({co2}) AND {co2} >= 400 AND {co2} <= 480)",
             "high": f"(isnan({co2}) OR {co2} > 480)"}[co2_level]
    cond.append(level)
    return f"""SELECT Arret.id_arret, Arret.nom AS arret,
    CASE WHEN fq.id_arret IS NOT NULL THEN fq.quartier ELSE 'Inconnu' END AS quartier,
    COALESCE(lvm.v_type, 'Inconnu') AS type_vehicule,
    CAST(COALESCE(cnt.nb_lignes, 1) AS BIGINT) AS nb_lignes,
    Arret.latitude, Arret.longitude,
    ROUND({co2}, 1) AS co2_ppm,
    CASE WHEN ps.bruit IS NOT NULL AND ps.bruit <> 0 THEN ROUND(ps.bruit, 1) END AS bruit_db,
    CASE WHEN ps.temp IS NOT NULL AND ps.temp <> 0 THEN ROUND(ps.temp, 1) END AS temp_c
FROM Arret
    LEFT JOIN ({_per_stop(True)}) ps ON ps.id_arret = Arret.id_arret
    LEFT JOIN (SELECT ArretQuartier.id_arret, arg_min(Quartier.nom, Quartier.id_quartier) AS quartier
               FROM ArretQuartier JOIN Quartier ON Quartier.id_quartier = ArretQuartier.id_quartier
               GROUP BY ArretQuartier.id_arret) fq ON fq.id_arret = Arret.id_arret
    LEFT JOIN ({LVM}) lvm ON lvm.id_ligne = Arret.id_ligne
    LEFT JOIN (SELECT nom, COUNT(DISTINCT id_ligne) AS nb_lignes FROM Arret GROUP BY nom) cnt
        ON cnt.nom = Arret.nom
WHERE {' AND '.join(cond)}"""


def _round_board(sql: str) -> str:
    return f"""SELECT id_arret, arret, quartier, type_vehicule, nb_lignes, (ROUND(latitude, 6) + CAST(0 AS DOUBLE)) AS latitude,
    (ROUND(longitude, 6) + CAST(0 AS DOUBLE)) AS longitude, (ROUND(co2_ppm, 6) + CAST(0 AS DOUBLE)) AS co2_ppm, (ROUND(bruit_db, 6) + CAST(0 AS DOUBLE)) AS bruit_db,
    (ROUND(temp_c, 6) + CAST(0 AS DOUBLE)) AS temp_c FROM ({sql}) b"""


BOARD = board_sql()

STOP_MEASURES = """Arret JOIN Capteur ON Capteur.id_arret = Arret.id_arret
    JOIN Mesure ON Mesure.id_capteur = Capteur.id_capteur"""

D09 = f"""SELECT Quartier.id_quartier, Quartier.nom AS nom_quartier, {_doc_avg('valeur')} AS avg_co2
FROM {STOP_MEASURES}
    JOIN ArretQuartier ON ArretQuartier.id_arret = Arret.id_arret
    JOIN Quartier ON Quartier.id_quartier = ArretQuartier.id_quartier
WHERE regexp_matches(type_capteur, '(?i)CO2')
GROUP BY Quartier.id_quartier, Quartier.nom"""

WKT_RING = r"""list_transform(
        list_filter(list_transform(string_split(replace(replace(geojson, 'POLYGON((', ''), '))', ''), ','),
                                   lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')),
                    lambda p: contains(p, ' ')),
        lambda p: list_transform(string_split_regex(p, '\s+')[1:2], lambda x: TRY_CAST(x AS DOUBLE)))"""

WKT = f"""SELECT id_quartier, nom, ring,
    CASE WHEN ring[1] IS DISTINCT FROM ring[len(ring)] THEN len(ring) + 1 ELSE len(ring) END AS n_points
FROM (SELECT id_quartier, nom, {WKT_RING} AS ring FROM Quartier WHERE starts_with(geojson, 'POLYGON')) w
WHERE len(ring) > 0 AND NOT list_bool_or(list_transform(ring, lambda pt: pt IS NULL OR len(pt) < 2
                                                         OR list_bool_or(list_transform(pt, lambda x: x IS NULL))))"""

W1 = f"""WITH t AS (
    SELECT id_ligne, retard_minutes AS y,
           row_number() OVER (PARTITION BY id_ligne ORDER BY id_trafic, retard_minutes) - 1 AS pos
    FROM Trafic),
c AS (
    SELECT Arret.id_ligne, Mesure.valeur AS x,
           row_number() OVER (PARTITION BY Arret.id_ligne
                              ORDER BY Arret.id_arret, Capteur.id_capteur, Mesure.horodatage, Mesure.valeur) - 1 AS pos
    FROM {STOP_MEASURES} WHERE Capteur.type_capteur = 'CO2'),
pairs AS (SELECT t.id_ligne, x, y, x IS NOT NULL AND y IS NOT NULL AS ok FROM t JOIN c ON t.id_ligne = c.id_ligne AND t.pos = c.pos),
r AS (SELECT id_ligne, COUNT(*) AS n_raw,
             CASE WHEN COUNT(*) FILTER (WHERE ok) > 1 AND var_pop(x) FILTER (WHERE ok) > 0 AND var_pop(y) FILTER (WHERE ok) > 0
                  THEN corr(x, y) FILTER (WHERE ok) END AS corr
      FROM pairs GROUP BY id_ligne)
SELECT nom_ligne, (ROUND(corr, 6) + CAST(0 AS DOUBLE)) AS correlation
FROM r JOIN Ligne ON Ligne.id_ligne = r.id_ligne
WHERE n_raw > 1 AND corr IS NOT NULL"""


def _q1() -> str:
    parts = []
    for letter in S.REPORT_COLUMNS:
        rel, doc = REL[f"R_{letter}_rel"], DOC[f"R_{letter}_doc"]
        parts.append(f"""SELECT '{letter}' AS report, 'n_rel' AS measure, COUNT(*) AS n FROM ({rel}) x
UNION ALL SELECT '{letter}', 'n_doc', COUNT(*) FROM ({doc}) x
UNION ALL SELECT '{letter}', 'only_rel', COUNT(*) FROM (SELECT * FROM ({rel}) a EXCEPT ALL SELECT * FROM ({doc}) b) x
UNION ALL SELECT '{letter}', 'only_doc', COUNT(*) FROM (SELECT * FROM ({doc}) a EXCEPT ALL SELECT * FROM ({rel}) b) x""")
    return "\nUNION ALL ".join(parts)


def _q3() -> str:
    parts = []
    for child, ccol, parent, pcol in S.FOREIGN_KEYS:
        parts.append(f"""SELECT '{child}.{ccol}' AS fk, '{parent}.{pcol}' AS ref, COUNT(*) AS orphans
FROM {child} c WHERE c.{ccol} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pcol} = c.{ccol})""")
    return "\nUNION ALL ".join(parts)


def _over(letter: str) -> str:
    return f"({RAW_DOC[f'R_{letter}_doc']})"


_TEMP_EXTREMES = f"""(SELECT nom_ligne, avg_temperature, 'top' AS groupe FROM {_over('j')} j
     ORDER BY avg_temperature DESC NULLS LAST, nom_ligne LIMIT 10)
UNION ALL
(SELECT nom_ligne, avg_temperature, 'bottom' AS groupe FROM {_over('j')} j
     ORDER BY avg_temperature IS NULL DESC, avg_temperature ASC, nom_ligne DESC LIMIT 10)"""

_DRIVERS = f"""SELECT * FROM {_over('k')} k ORDER BY avg_retard_minutes ASC NULLS LAST, chauffeur_nom LIMIT 10"""

_HIST = f"""WITH d AS {_over('d')},
st AS (SELECT MIN(avg_co2) AS lo, MAX(avg_co2) AS hi FROM d),
w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 20 ELSE 1.0 END AS width FROM st),
b AS (SELECT type_vehicule, LEAST(CAST(floor((avg_co2 - lo) / width) AS INTEGER), 19) AS bin, lo, width
      FROM d, w WHERE avg_co2 IS NOT NULL)
SELECT type_vehicule, bin, (ROUND(lo + bin * width, 6) + CAST(0 AS DOUBLE)) AS bin_start, (ROUND(lo + (bin + 1) * width, 6) + CAST(0 AS DOUBLE)) AS bin_end,
       COUNT(*) AS n
FROM b GROUP BY type_vehicule, bin, lo, width"""


def _trend(condition: str) -> str:
    return f"""SELECT strftime(CAST(Mesure.horodatage AS DATE), '%Y-%m-%d') AS date, {_rr(_doc_avg('valeur'))} AS moyenne_co2
FROM {STOP_MEASURES} WHERE type_capteur = 'CO2' AND {condition} GROUP BY 1"""


def _ranked(letter: str, column: str, order: str, where: str = "TRUE") -> str:
    return f"""SELECT nom, {_rr(column)} AS {column}, rang FROM (
    SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rang FROM {_over(letter)} x) y WHERE {where}"""


def _nested_stops(k: int) -> str:
    """Documents of the stop collection in parts of k children: sizes and sums that depend on values and order."""
    return f"""WITH cp AS (
    SELECT c.id_arret, c.id_capteur, m.horodatage, m.valeur, m.unite, m.id_capteur IS NOT NULL AS present,
           (row_number() OVER (PARTITION BY c.id_arret ORDER BY c.id_capteur, m.horodatage NULLS FIRST, m.valeur, m.unite) - 1) // {k} AS part
    FROM Capteur c LEFT JOIN Mesure m ON m.id_capteur = c.id_capteur WHERE c.id_arret IS NOT NULL),
ci AS (
    SELECT *, dense_rank() OVER (PARTITION BY id_arret, part ORDER BY id_capteur) AS e,
           row_number() OVER (PARTITION BY id_arret, part, id_capteur ORDER BY horodatage, valeur, unite) AS i FROM cp),
cs AS (
    SELECT id_arret, part, COUNT(DISTINCT id_capteur) AS n_capteurs, COUNT(*) FILTER (WHERE present) AS n_mesures,
           SUM((e * 31 + i) * (id_capteur % 97 + CAST(round(valeur * 10) AS BIGINT) + day(horodatage))) FILTER (WHERE present) AS sum_mesures
    FROM ci GROUP BY ALL),
hp AS (SELECT *, row_number() OVER (PARTITION BY id_arret ORDER BY id_horaire) - 1 AS pos FROM Horaire WHERE id_arret IS NOT NULL),
hs AS (
    SELECT id_arret, pos // {k} AS part, COUNT(*) AS n_horaires,
           SUM((pos % {k} + 1) * (id_vehicule + COALESCE(passagers_estimes, -1) + day(heure_prevue))) AS sum_horaires
    FROM hp GROUP BY ALL),
qp AS (
    SELECT b.id_arret, q.id_quartier, row_number() OVER (PARTITION BY b.id_arret ORDER BY q.id_quartier, q.nom) - 1 AS pos
    FROM ArretQuartier b JOIN Quartier q ON q.id_quartier = b.id_quartier),
qs AS (SELECT id_arret, pos // {k} AS part, COUNT(*) AS n_quartiers, SUM((pos % {k} + 1) * id_quartier) AS sum_quartiers FROM qp GROUP BY ALL),
keys AS (
    SELECT id_arret, part FROM cs UNION SELECT id_arret, part FROM hs UNION SELECT id_arret, part FROM qs
    UNION SELECT id_arret, 0 FROM Arret)
SELECT a.id_arret, CAST(k.part AS BIGINT) AS part, {", ".join(f"CAST(COALESCE({c}, 0) AS BIGINT) AS {c}" for c in (
        "n_quartiers", "n_capteurs", "n_mesures", "n_horaires", "sum_quartiers", "sum_mesures", "sum_horaires"))}
FROM Arret a JOIN keys k ON k.id_arret = a.id_arret LEFT JOIN cs ON cs.id_arret = a.id_arret AND cs.part = k.part
    LEFT JOIN hs ON hs.id_arret = a.id_arret AND hs.part = k.part LEFT JOIN qs ON qs.id_arret = a.id_arret AND qs.part = k.part"""


def _nested_traffic(k: int) -> str:
    return f"""WITH ip AS (SELECT *, row_number() OVER (PARTITION BY id_trafic ORDER BY horodatage, id_incident) - 1 AS pos FROM Incident),
ps AS (SELECT id_trafic, pos // {k} AS part, COUNT(*) AS n, SUM((pos % {k} + 1) * (gravite * 100 + day(horodatage))) AS s FROM ip GROUP BY ALL)
SELECT t.id_trafic, CAST(COALESCE(ps.part, 0) AS BIGINT) AS part, t.id_ligne, t.retard_minutes,
    CAST(COALESCE(ps.n, 0) AS BIGINT) AS n_incidents, CAST(COALESCE(ps.s, 0) AS BIGINT) AS sum_incidents
FROM Trafic t LEFT JOIN ps ON ps.id_trafic = t.id_trafic"""


# The features that the district jobs read: valid districts in id order.
_FEATURES = f"(SELECT *, row_number() OVER (ORDER BY id_quartier) - 1 AS idx FROM ({WKT}) w)"
_SYNTH = "(SELECT *, row_number() OVER (ORDER BY id_quartier, nom) - 1 AS idx FROM Quartier)"
_MAPPING = f"""(SELECT s.id_quartier, s.nom AS nom_synthetique, f.nom AS nom_reel, 0 AS arrondissement, f.idx AS index_geojson, f.ring
    FROM {_SYNTH} s JOIN {_FEATURES} f ON f.idx = s.idx)"""

PRODUCTS: dict[str, str] = {
    "W1_corr_positional": W1,
    "D01_line_vehicle_map": "SELECT id_ligne, v_type AS type_vehicule FROM (" + LVM + ") l",
    "D02_stop_line_counts": "SELECT nom, COUNT(DISTINCT id_ligne) AS nb_lignes FROM Arret GROUP BY nom",
    "D03_line_options": "SELECT nom_ligne AS label, id_ligne AS value FROM Ligne",
    "D03_vehicle_options": f"SELECT DISTINCT v_type AS label FROM ({LVM}) l",
    "D04_stop_board": _round_board(BOARD),
    "D04_stop_board_medium": _round_board(board_sql(co2_level="medium")),
    "D04_stop_board_diesel_low": _round_board(board_sql(vehicle_type="Diesel", co2_level="low")),
    "D04_stop_board_line_7": _round_board(board_sql(id_ligne=7)),
    "D04_stop_board_high": _round_board(board_sql(co2_level="high")),
    "D04_stop_board_other_type": _round_board(board_sql(id_ligne=7, vehicle_type=OTHER_TYPE)),
    "D05_co2_trend": _trend(f"Arret.nom IN (SELECT arret FROM ({board_sql(vehicle_type='Electrique')}) b)"),
    "D05_co2_trend_line_7": _trend(f"Arret.nom IN (SELECT arret FROM ({board_sql(id_ligne=7, co2_level='high')}) b)"),
    "D05_co2_trend_network": _trend("TRUE"),
    "D06_stop_markers": f"""SELECT id_arret, arret, (ROUND(latitude, 6) + CAST(0 AS DOUBLE)) AS latitude, (ROUND(longitude, 6) + CAST(0 AS DOUBLE)) AS longitude,
    (ROUND(co2_ppm, 6) + CAST(0 AS DOUBLE)) AS co2_ppm,
    CASE WHEN co2_ppm > 550 THEN 'darkred' WHEN co2_ppm > 480 THEN 'red' WHEN co2_ppm > 400 THEN 'orange'
         ELSE 'green' END AS couleur,
    CASE WHEN nb_lignes > 1 THEN 'exchange' ELSE 'bus' END AS icone,
    arret || ' (' || CAST(co2_ppm AS VARCHAR) || ' ppm)' AS infobulle
FROM ({BOARD}) b""",
    "D06_map_centre": f"""SELECT (ROUND(COALESCE(AVG(latitude), 48.8566), 6) + CAST(0 AS DOUBLE)) AS centre_lat,
    (ROUND(COALESCE(AVG(longitude), 2.3522), 6) + CAST(0 AS DOUBLE)) AS centre_lon FROM ({BOARD}) b""",
    "D07_heat_points": f"""SELECT id_arret, (ROUND(lat, 6) + CAST(0 AS DOUBLE)) AS lat, (ROUND(lon, 6) + CAST(0 AS DOUBLE)) AS lon, (ROUND(valeur, 6) + CAST(0 AS DOUBLE)) AS valeur FROM (
    SELECT Arret.id_arret, ANY_VALUE(Arret.latitude) AS lat, ANY_VALUE(Arret.longitude) AS lon,
           {_doc_avg('valeur')} AS valeur
    FROM {STOP_MEASURES}
    WHERE regexp_matches(type_capteur, '(?i)CO2|Pollution')
    GROUP BY Arret.id_arret) h
WHERE valeur > 0 AND NOT isnan(valeur)""",
    "D08_stop_details": f"""SELECT Arret.id_arret, COALESCE(NULLIF(Arret.nom, ''), 'Arrêt sans nom') AS nom,
    (ROUND(latitude, 6) + CAST(0 AS DOUBLE)) AS lat, (ROUND(longitude, 6) + CAST(0 AS DOUBLE)) AS lon, id_ligne AS ligne,
    (ROUND(ps.co2, 6) + CAST(0 AS DOUBLE)) AS co2, (ROUND(ps.bruit, 6) + CAST(0 AS DOUBLE)) AS bruit, (ROUND(ps.temp, 6) + CAST(0 AS DOUBLE)) AS temp,
    CASE WHEN COALESCE(ps.co2, 0) > 500 THEN 'red' WHEN COALESCE(ps.co2, 0) > 400 THEN 'orange' ELSE 'green' END
        AS couleur,
    COALESCE(printf('%.1f', ROUND(ps.co2, 1)), 'N/A') AS co2_txt,
    COALESCE(printf('%.1f', ROUND(ps.bruit, 1)), 'N/A') AS bruit_txt,
    COALESCE(printf('%.1f', ROUND(ps.temp, 1)), 'N/A') AS temp_txt
FROM Arret LEFT JOIN ({_per_stop(False)}) ps ON ps.id_arret = Arret.id_arret""",
    "D09_co2_by_quartier": f"SELECT id_quartier, nom_quartier, (ROUND(avg_co2, 6) + CAST(0 AS DOUBLE)) AS avg_co2 FROM ({D09}) q",
    "D10_quartier_features": f"""SELECT w.id_quartier, w.nom, (ROUND(ROUND(COALESCE(q.avg_co2, 0.0), 2), 6) + CAST(0 AS DOUBLE)) AS avg_co2,
    COALESCE(q.nom_quartier, w.nom) AS nom_complet
FROM ({WKT}) w LEFT JOIN ({D09}) q ON q.id_quartier = w.id_quartier""",
    "D10_feature_json": f"""SELECT id_quartier, CAST(to_json({{'type': 'Feature', 'id': id_quartier,
    'properties': {{'id_quartier': id_quartier, 'nom': nom, 'avg_co2': avg_co2, 'nom_complet': nom_complet}},
    'geometry': {{'type': 'Polygon', 'coordinates': [CASE WHEN n_points > len(ring) THEN list_append(ring, ring[1]) ELSE ring END]}}}}) AS VARCHAR) AS feature
FROM (SELECT w.id_quartier, w.nom, w.ring, w.n_points, ROUND(COALESCE(q.avg_co2, 0.0), 2) AS avg_co2, COALESCE(q.nom_quartier, w.nom) AS nom_complet
      FROM ({WKT}) w LEFT JOIN ({D09}) q ON q.id_quartier = w.id_quartier) x""",
    "D11_noise_axis": f"""SELECT (ROUND(MIN(avg_bruit) * 0.98, 6) + CAST(0 AS DOUBLE)) AS y_min, (ROUND(MAX(avg_bruit) * 1.01, 6) + CAST(0 AS DOUBLE)) AS y_max
FROM {_over('e')} e""",
    "D12_temp_extremes": f"""SELECT nom_ligne, {_rr('avg_temperature')} AS avg_temperature, groupe,
    CAST(row_number() OVER (ORDER BY groupe DESC, CASE WHEN groupe = 'top' THEN avg_temperature IS NULL ELSE avg_temperature IS NOT NULL END,
        CASE WHEN groupe = 'top' THEN -avg_temperature ELSE avg_temperature END,
        CASE WHEN groupe = 'top' THEN nom_ligne END, CASE WHEN groupe = 'bottom' THEN nom_ligne END DESC) AS INTEGER) AS rang
FROM ({_TEMP_EXTREMES}) x""",
    "D12_temp_bounds": f"""SELECT (ROUND(MIN(avg_temperature) * 0.99, 6) + CAST(0 AS DOUBLE)) AS y_min, (ROUND(MAX(avg_temperature) * 1.01, 6) + CAST(0 AS DOUBLE)) AS y_max
FROM ({_TEMP_EXTREMES}) x""",
    "D13_worst_lines": _ranked("a", "avg_retard", "avg_retard DESC NULLS LAST, nom_ligne", "rang <= 15").replace("SELECT nom,", "SELECT nom_ligne,"),
    "D14_drivers_10": _ranked("k", "avg_retard_minutes", "avg_retard_minutes ASC NULLS LAST, chauffeur_nom", "rang <= 10").replace(
        "SELECT nom,", "SELECT chauffeur_nom,"),
    "D14_drivers_bounds": f"""SELECT (ROUND(MIN(avg_retard_minutes) * 0.90, 6) + CAST(0 AS DOUBLE)) AS y_min,
    (ROUND(MAX(avg_retard_minutes) * 1.05, 6) + CAST(0 AS DOUBLE)) AS y_max FROM ({_DRIVERS}) x""",
    "D15_co2_histogram": _HIST,
    "D16_delay_class_counts": f"""SELECT classification_retard, COUNT(*) AS nb_lignes FROM {_over('n')} n
WHERE classification_retard IS NOT NULL GROUP BY classification_retard""",
    "D17_daily_passengers": f"""SELECT jour, (ROUND(AVG(avg_passagers), 6) + CAST(0 AS DOUBLE)) AS avg_passagers FROM {_over('b')} b
WHERE jour IS NOT NULL GROUP BY jour""",
    "D18_electric_ranked": _ranked("l", "taux_electrique", "taux_electrique DESC NULLS LAST, nom_ligne").replace("SELECT nom,", "SELECT nom_ligne,"),
    "D18_corr_ranked": _ranked("i", "correlation", "correlation ASC NULLS LAST, nom_ligne").replace("SELECT nom,", "SELECT nom_ligne,"),
    "D18_incident_scatter": DOC["R_c_doc"],
    "D19_punctuality_pct": f"""SELECT (ROUND(taux_sans_retard * 100, 6) + CAST(0 AS DOUBLE)) AS ponctualite_pct,
    printf('%.2f%%', ROUND(taux_sans_retard * 100, 2)) AS ponctualite_txt FROM {_over('g')} g""",
    "D20_selection_mix": f"""SELECT type_vehicule, COUNT(*) AS nombre FROM ({BOARD}) b
WHERE type_vehicule IS NOT NULL GROUP BY type_vehicule""",
    "M1_nest_lignes": "SELECT * FROM Ligne",
    "M2_nest_arrets": _nested_stops(50_000),
    "M2_nest_arrets_split": _nested_stops(5),
    "M3_nest_vehicules": """SELECT v.id_vehicule, v.immatriculation, v.id_ligne, v.type_vehicule, v.capacite, v.id_chauffeur,
    c.nom AS chauffeur_nom, c.date_embauche
FROM Vehicule v LEFT JOIN Chauffeur c ON c.id_chauffeur = v.id_chauffeur""",
    "M4_nest_trafic": _nested_traffic(50_000),
    "M4_nest_trafic_split": _nested_traffic(2),
    "M5_quartiers_from_geojson": f"""SELECT idx + 1 AS id_quartier, nom, nom AS nom_officiel, '' AS code_quartier, 0 AS arrondissement,
    CAST(n_points AS BIGINT) AS n_points, CAST(0 AS DOUBLE) AS surface, CAST(0 AS DOUBLE) AS perimetre, TRUE AS is_real_paris FROM {_FEATURES} f""",
    "M6_rejects": f"""SELECT id_quartier, 'unparseable coordinate' AS reason FROM Quartier
WHERE id_quartier NOT IN (SELECT id_quartier FROM ({WKT}) w)""",
    "M8_quartier_mapping": f"SELECT id_quartier, nom_synthetique, nom_reel, arrondissement, index_geojson FROM {_MAPPING} m",
    "M9_apply_mapping": f"""SELECT COALESCE(m.id_quartier, w.id_quartier) AS id_quartier, w.nom, m.nom_synthetique, m.nom_reel, m.arrondissement,
    COALESCE(m.ring, w.ring)[1][1] AS first_lon, w.is_real_paris
FROM {_MAPPING} m FULL JOIN (SELECT *, FALSE AS is_real_paris FROM ({WKT}) w) w ON w.id_quartier = m.id_quartier""",
    "M6_quartiers_from_wkt": f"""SELECT id_quartier, nom, n_points, (ROUND(ring[1][1], 6) + CAST(0 AS DOUBLE)) AS first_lon,
    (ROUND(ring[1][2], 6) + CAST(0 AS DOUBLE)) AS first_lat, (ROUND(ring[1][1], 6) + CAST(0 AS DOUBLE)) AS last_lon, FALSE AS is_real_paris
FROM ({WKT}) w""",
    "M7_load_statistics": """SELECT 'lignes' AS collection, COUNT(*) AS n FROM Ligne
UNION ALL SELECT 'arrets', COUNT(*) FROM Arret
UNION ALL SELECT 'vehicules', COUNT(*) FROM Vehicule
UNION ALL SELECT 'trafic', COUNT(*) FROM Trafic
UNION ALL SELECT 'mesures', COUNT(*) FROM Mesure WHERE id_capteur IS NOT NULL
UNION ALL SELECT 'incidents', COUNT(*) FROM Incident WHERE id_trafic IS NOT NULL
UNION ALL SELECT 'quartiers', COUNT(*) FROM """ + _FEATURES + """ f
UNION ALL SELECT 'quartiers_reels', COUNT(*) FROM """ + _FEATURES + " f",
    "Q1_parity": _q1(),
    "Q3_integrity": _q3(),
}

# the same products over the report files, written and read again
PRODUCTS |= {"D13_worst_lines_from_csv": PRODUCTS["D13_worst_lines"], "D16_delay_class_counts_from_csv": PRODUCTS["D16_delay_class_counts"],
             "D18_electric_ranked_from_csv": PRODUCTS["D18_electric_ranked"], "D17_daily_passengers_from_csv": PRODUCTS["D17_daily_passengers"]}

# Stored forms (plans/catalog_stored.py): features of the parts, planted text rows, places in a written report.
_PART_FEATURES = """(SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx,
    CASE WHEN p_partkey % 7 <> 0 THEN CASE WHEN p_partkey % 13 = 0 THEN p_name || ' \\"}],{' ELSE p_name END END AS l_qu,
    CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS c_qu, CASE WHEN p_partkey % 11 <> 0 THEN p_size END AS c_ar,
    CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS surface, CASE WHEN p_partkey % 2 <> 0 THEN p_retailprice / 4 END AS perimetre,
    p_size FROM part)"""
_PART_MAPPING = f"""(SELECT q.id_quartier, q.nom AS nom_synthetique, COALESCE(f.l_qu, '') AS nom_reel, COALESCE(f.c_ar, 0) AS arrondissement, f.p_size
    FROM (SELECT id_quartier, nom, row_number() OVER (ORDER BY id_quartier, nom) - 1 AS i FROM Quartier) q JOIN {_PART_FEATURES} f ON f.idx = q.i)"""


def _placed(body: str, columns: str, order: str) -> str:
    return f"SELECT {columns}, row_number() OVER (ORDER BY {order}) AS rang FROM ({body}) x"


_REREAD = {
    "b": _placed(RAW_REL["R_b_rel"], f"nom_ligne, jour, {_rr('avg_passagers')} AS avg_passagers", "nom_ligne NULLS FIRST, jour NULLS FIRST"),
    "d": _placed(RAW_REL["R_d_rel"], f"immatriculation, type_vehicule, {_rr('avg_co2')} AS avg_co2", "immatriculation NULLS FIRST"),
    "k": _placed(RAW_REL["R_k_rel"], f"chauffeur_nom, {_rr('avg_retard_minutes')} AS avg_retard_minutes", "chauffeur_nom NULLS FIRST"),
    "m": f"""SELECT id_capteur, {_rr('latitude')} AS latitude, {_rr('longitude')} AS longitude, {_rr('valeur')} AS valeur,
    CASE WHEN valeur < 400 THEN 'faible' WHEN valeur < 500 THEN 'moyen' ELSE 'élevé' END AS niveau_pollution,
    row_number() OVER (ORDER BY id_capteur, horodatage NULLS FIRST, valeur NULLS FIRST) AS rang
FROM Mesure JOIN (SELECT id_capteur, latitude, longitude FROM Capteur WHERE type_capteur = 'CO2') c USING (id_capteur)""",
}

PRODUCTS |= {
    "M5_quartiers_from_geojson_file": f"""SELECT idx + 1 AS id_quartier, COALESCE(l_qu, 'Quartier-' || (idx + 1)) AS nom,
    COALESCE(l_qu, 'Quartier-' || (idx + 1)) AS nom_officiel, COALESCE(c_qu, '') AS code_quartier, COALESCE(c_ar, 0) AS arrondissement,
    {_rr('COALESCE(surface, 0)')} AS surface, {_rr('COALESCE(perimetre, 0)')} AS perimetre, TRUE AS is_real_paris, CAST(4 AS BIGINT) AS n_points,
    CAST(p_size + 1 AS DOUBLE) AS second_lon FROM {_PART_FEATURES} f""",
    "M7_written_statistics": PRODUCTS["M7_load_statistics"].split("UNION ALL SELECT 'quartiers'")[0]
    + "UNION ALL SELECT 'quartiers', COUNT(*) FROM part UNION ALL SELECT 'quartiers_reels', COUNT(*) FROM part",
    "M9_upsert_from_json_map": f"""SELECT COALESCE(m.id_quartier, w.id_quartier) AS id_quartier, w.nom, m.nom_synthetique, m.nom_reel, m.arrondissement,
    CASE WHEN m.id_quartier IS NOT NULL THEN CAST(m.p_size AS DOUBLE) ELSE w.ring[1][1] END AS first_lon, w.is_real_paris
FROM {_PART_MAPPING} m FULL JOIN (SELECT *, FALSE AS is_real_paris FROM ({WKT}) w) w ON w.id_quartier = m.id_quartier""",
    "S8_replaced_by_itself": """SELECT id_vehicule, type_vehicule, capacite + 1 AS capacite, c.nom AS chauffeur_nom
FROM Vehicule LEFT JOIN Chauffeur c USING (id_chauffeur) WHERE type_vehicule <> 'Diesel'""",
    "F4_load_rejects": """SELECT 'Trafic' AS table_name, id_trafic AS id, 'horodatage' AS column_name, '2045-13-45 99:00:00' AS value, 'bad timestamp' AS reason
FROM Trafic WHERE id_trafic % 97 = 0
UNION ALL SELECT 'Trafic', id_trafic, 'retard_minutes', 'douze', 'not a number' FROM Trafic WHERE id_trafic % 89 = 0
UNION ALL SELECT 'Horaire', id_horaire, 'heure_prevue', 'hier', 'bad timestamp' FROM Horaire WHERE id_horaire % 83 = 0
UNION ALL SELECT 'Incident', id_incident, NULL, id_incident || ',' || id_trafic, 'malformed line' FROM Incident WHERE id_incident % 101 = 0""",
    "F4_loaded_rows": """SELECT 'Trafic' AS table_name, COUNT(*) AS n, CAST(0 AS BIGINT) AS n_missing FROM Trafic WHERE id_trafic % 97 <> 0 AND id_trafic % 89 <> 0
UNION ALL SELECT 'Horaire', COUNT(*), COUNT(*) FILTER (WHERE id_horaire % 79 = 0) FROM Horaire WHERE id_horaire % 83 <> 0
UNION ALL SELECT 'Incident', COUNT(*), 0 FROM Incident WHERE id_incident % 101 <> 0""",
    "F4_loaded_report_a": f"""SELECT nom_ligne, {_rr('v')} AS avg_retard FROM Ligne LEFT JOIN (
    SELECT id_ligne, AVG(retard_minutes) AS v FROM Trafic WHERE id_trafic % 97 <> 0 AND id_trafic % 89 <> 0 GROUP BY id_ligne) t USING (id_ligne)""",
    "Q4_result_page": f"SELECT * FROM ({_REREAD['m']}) x WHERE rang BETWEEN 151 AND 200",
    "Q4_view_result": f"SELECT * EXCLUDE (rang), (SELECT COUNT(*) FROM ({_REREAD['m']}) y) AS n_rows FROM ({_REREAD['m']}) x WHERE rang BETWEEN 51 AND 75",
    "S11_result_list": f"""SELECT 'requete_a.csv' AS result, COUNT(*) AS n_rows FROM ({REL['R_a_rel']}) a
UNION ALL SELECT 'requete_l.csv', COUNT(*) FROM ({REL['R_l_rel']}) l UNION ALL SELECT 'requete_n.csv', COUNT(*) FROM ({REL['R_n_rel']}) n""",
    "S12_preview": "SELECT id_quartier, nom, substring(geojson, 1, 12) AS geojson FROM Quartier ORDER BY id_quartier LIMIT 5",
    "D04_stored_board_line_7": PRODUCTS["D04_stop_board_line_7"],
    "D04_stored_board_diesel_low": PRODUCTS["D04_stop_board_diesel_low"],
    "D20_stored_selection_mix": PRODUCTS["D20_selection_mix"],
} | {f"O2_report_{k}_reread": sql for k, sql in _REREAD.items()}
