"""DuckDB twins of the registered queries (the correctness oracle).

Each entry is plain SQL over the driver tables, with the transit tables
defined as CTEs by ``with_views`` (the same bindings the Spark side uses).
CTEs, membership tests, bands as value tables, a correlation centred on the means of the pairs.
Doubles are rounded to 6 places on both sides, since summation order differs
between engines.
"""

from __future__ import annotations

from transitlake.functions.calc import DELAY_BANDS, DELAY_ELSE, POLLUTION_BANDS, POLLUTION_ELSE
from transitlake.sources.binding import BUS_TYPE, with_views


def rounded(expr: str) -> str:
    return f"(ROUND({expr}, 6) + CAST(0 AS DOUBLE))"  # + 0.0 folds -0.0 into 0.0


def doc_avg(col: str) -> str:
    """A document-profile mean: one missing value (stored as NaN) voids the group."""
    return f"CASE WHEN COUNT(*) FILTER (WHERE {col} IS NULL) > 0 THEN NULL ELSE AVG({col}) END"


def bands(name: str, limits, last: str) -> str:
    """A value table (lo, hi, label) of half-open bands."""
    lows = ["-1e308", *[f"{t}" for t, _ in limits]]
    highs = [*[f"{t}" for t, _ in limits], "1e308"]
    rows = ", ".join(f"({lo}, {hi}, '{label}')" for lo, hi, label in zip(lows, highs, [*[b for _, b in limits], last]))
    return f"{name}(lo, hi, label) AS (VALUES {rows})"


# Sums of one sensor type by stop; what a stop's line is called.
def _stop_sums(kind: str) -> str:
    return (f"stop_sums AS (SELECT c.id_arret, SUM(m.valeur) AS s, COUNT(m.valeur) AS n, COUNT(*) AS k "
            f"FROM Mesure m SEMI JOIN (SELECT id_capteur FROM Capteur WHERE type_capteur = '{kind}') t USING (id_capteur) "
            f"JOIN Capteur c USING (id_capteur) GROUP BY c.id_arret)")


_STOP_LINE = "stop_line AS (SELECT a.id_arret, l.id_ligne, l.nom_ligne FROM Arret a JOIN Ligne l USING (id_ligne))"
_DELAYS = ("delays AS (SELECT id_ligne, SUM(retard_minutes) AS s, COUNT(retard_minutes) AS n, COUNT(*) AS k, "
           "AVG(retard_minutes) AS mean FROM Trafic GROUP BY id_ligne)")
_INCIDENTS = ("incidents AS (SELECT t.id_ligne, COUNT(*) AS k FROM Incident i JOIN Trafic t USING (id_trafic) GROUP BY t.id_ligne)")

# Per line and day: both sides of the same-day pairs, and per line the means over all pairs.
_SIDES = f"""{_STOP_LINE},
xs AS (SELECT sl.id_ligne, sl.nom_ligne, CAST(m.horodatage AS DATE) AS d, m.valeur AS x
       FROM Mesure m JOIN Capteur c USING (id_capteur) JOIN stop_line sl USING (id_arret) WHERE c.type_capteur = 'CO2'),
ys AS (SELECT id_ligne, CAST(horodatage AS DATE) AS d, retard_minutes AS y FROM Trafic),
xd AS (SELECT id_ligne, nom_ligne, d, COUNT(*) AS n, SUM(x) AS sx FROM xs GROUP BY ALL),
yd AS (SELECT id_ligne, d, COUNT(*) AS m, SUM(y) AS sy, SUM(y * y) AS syy FROM ys GROUP BY ALL),
means AS (SELECT id_ligne, nom_ligne, SUM(n::HUGEINT * m) AS pairs, SUM(sx * m) / SUM(n * m) AS mx, SUM(sy * n) / SUM(n * m) AS my,
          SUM(sy::HUGEINT * n) AS ty, SUM(syy::HUGEINT * n) AS tyy FROM xd JOIN yd USING (id_ligne, d) GROUP BY ALL),
cx AS (SELECT xs.id_ligne, d, SUM(x - mx) AS ex, SUM((x - mx) * (x - mx)) AS vx FROM xs JOIN means USING (id_ligne) GROUP BY ALL),
cy AS (SELECT ys.id_ligne, d, SUM(y - my) AS ey, SUM((y - my) * (y - my)) AS vy FROM ys JOIN means USING (id_ligne) GROUP BY ALL),
centred AS (SELECT id_ligne, SUM(ex * ey) AS cov, SUM(vx * m) AS vx, SUM(vy * n) AS vy
            FROM cx JOIN cy USING (id_ligne, d) JOIN xd USING (id_ligne, d) JOIN yd USING (id_ligne, d) GROUP BY id_ligne)"""


def _correlation(vy: str, least: int, r) -> str:
    return f"""WITH {_SIDES}
SELECT nom_ligne, {r(f'CASE WHEN pairs > {least} AND vx > 0 AND {vy} > 0 THEN cov / (sqrt(vx) * sqrt({vy})) END')} AS correlation
FROM means JOIN centred USING (id_ligne) WHERE pairs > {least}"""


def _reports(r) -> tuple[dict[str, str], dict[str, str]]:
    delay, level = bands("classes", DELAY_BANDS, DELAY_ELSE), bands("levels", POLLUTION_BANDS, POLLUTION_ELSE)
    rel = {
        "R_a_rel": f"WITH {_DELAYS} SELECT nom_ligne, {r('mean')} AS avg_retard FROM Ligne LEFT JOIN delays USING (id_ligne)",
        "R_b_rel": f"""WITH {_STOP_LINE},
daily AS (SELECT id_arret, CAST(heure_prevue AS DATE) AS d, SUM(passagers_estimes) AS s, COUNT(passagers_estimes) AS n FROM Horaire GROUP BY ALL)
SELECT nom_ligne, strftime(d, '%Y-%m-%d') AS jour, {r('SUM(s) / NULLIF(SUM(n), 0)')} AS avg_passagers
FROM daily LEFT JOIN stop_line USING (id_arret) GROUP BY id_ligne, nom_ligne, d""",
        "R_c_rel": f"""WITH {_DELAYS}, {_INCIDENTS}
SELECT nom_ligne, {r('CASE WHEN d.k > 0 THEN COALESCE(i.k, 0) / d.k END')} AS incident_taux
FROM Ligne LEFT JOIN delays d USING (id_ligne) LEFT JOIN incidents i USING (id_ligne)""",
        "R_d_rel": f"""WITH {_stop_sums('CO2')}, {_STOP_LINE},
line_sums AS (SELECT id_ligne, SUM(s) AS s, SUM(n) AS n FROM stop_sums LEFT JOIN stop_line USING (id_arret) GROUP BY id_ligne),
lonely AS (SELECT SUM(s) AS s, SUM(n) AS n, COUNT(*) AS k FROM line_sums
           WHERE id_ligne IS NULL OR id_ligne NOT IN (SELECT id_ligne FROM Vehicule WHERE id_ligne IS NOT NULL))
SELECT immatriculation, type_vehicule, {r('s / NULLIF(n, 0)')} AS avg_co2 FROM Vehicule JOIN line_sums USING (id_ligne)
UNION ALL SELECT NULL, NULL, {r('s / NULLIF(n, 0)')} FROM lonely WHERE k > 0""",
        "R_e_rel": f"""WITH {_stop_sums('Bruit')},
named AS (SELECT b.id_arret, q.id_quartier, q.nom FROM ArretQuartier b LEFT JOIN Quartier q USING (id_quartier)
          WHERE b.id_arret IN (SELECT id_arret FROM Arret)),
means AS (SELECT id_quartier, nom, SUM(s) / NULLIF(SUM(n), 0) AS v FROM stop_sums LEFT JOIN named USING (id_arret) GROUP BY ALL)
SELECT nom AS quartier_nom, {r('v')} AS avg_bruit FROM means ORDER BY v DESC NULLS LAST, nom ASC NULLS FIRST, id_quartier LIMIT 5""",
        "R_f_rel": """SELECT DISTINCT nom_ligne FROM Ligne WHERE id_ligne IN (
    SELECT id_ligne FROM Trafic WHERE retard_minutes > 10 AND id_trafic NOT IN (SELECT id_trafic FROM Incident WHERE id_trafic IS NOT NULL))""",
        "R_g_rel": f"SELECT {r('AVG(CASE WHEN retard_minutes = 0 THEN 1e0 ELSE 0e0 END)')} AS taux_sans_retard FROM Trafic",
        "R_h_rel": """SELECT nom AS quartier_nom, (SELECT COUNT(*) FROM ArretQuartier b WHERE b.id_quartier = Quartier.id_quartier) AS arret_count
FROM Quartier""",
        "R_i_rel": _correlation("vy", 0, r),
        "R_i_rel_trunc": _correlation("CAST(tyy - (ty * ty) // pairs AS DOUBLE)", 0, r),
        "R_j_rel": f"""WITH {_stop_sums('Temperature')}, {_STOP_LINE}
SELECT nom_ligne, {r('SUM(s) / NULLIF(SUM(n), 0)')} AS avg_temperature
FROM stop_sums LEFT JOIN stop_line USING (id_arret) GROUP BY id_ligne, nom_ligne""",
        "R_k_rel": f"""WITH {_DELAYS}, driven AS (SELECT id_chauffeur, SUM(s) / NULLIF(SUM(n), 0) AS v FROM Vehicule JOIN delays USING (id_ligne)
    WHERE id_ligne IN (SELECT id_ligne FROM Ligne) GROUP BY id_chauffeur)
SELECT nom AS chauffeur_nom, {r('v')} AS avg_retard_minutes FROM Chauffeur JOIN driven USING (id_chauffeur)""",
        "R_l_rel": f"""WITH share AS (SELECT id_ligne, AVG(CASE WHEN type_vehicule = 'Electrique' THEN 1e0 ELSE 0e0 END) AS v FROM Vehicule GROUP BY id_ligne)
SELECT nom_ligne, {r('v')} AS taux_electrique FROM Ligne JOIN share USING (id_ligne) WHERE type = '{BUS_TYPE}'""",
        "R_m_rel": f"""WITH {level}, co2 AS (SELECT * FROM Capteur WHERE type_capteur = 'CO2')
SELECT id_capteur, {r('latitude')} AS latitude, {r('longitude')} AS longitude, {r('valeur')} AS valeur,
    COALESCE(label, '{POLLUTION_ELSE}') AS niveau_pollution
FROM co2 JOIN Mesure USING (id_capteur) LEFT JOIN levels ON valeur >= lo AND valeur < hi""",
        "R_n_rel": f"""WITH {delay}, {_DELAYS}
SELECT nom_ligne, COALESCE(label, '{DELAY_ELSE}') AS classification_retard
FROM Ligne LEFT JOIN delays USING (id_ligne) LEFT JOIN classes ON mean >= lo AND mean < hi""",
    }
    doc = {
        "R_a_doc": f"WITH {_DELAYS} SELECT nom_ligne, {r('mean')} AS avg_retard FROM delays JOIN Ligne USING (id_ligne)",
        "R_b_doc": f"""WITH {_STOP_LINE}
SELECT nom_ligne, strftime(d, '%Y-%m-%d') AS jour, {r('v')} AS avg_passagers FROM (
    SELECT id_ligne, nom_ligne, CAST(heure_prevue AS DATE) AS d, {doc_avg('passagers_estimes')} AS v
    FROM stop_line JOIN Horaire USING (id_arret) GROUP BY ALL)""",
        "R_c_doc": f"""WITH {_DELAYS}, {_INCIDENTS}
SELECT nom_ligne, {r('COALESCE(i.k, 0) / d.k')} AS incident_taux FROM delays d JOIN Ligne USING (id_ligne) LEFT JOIN incidents i USING (id_ligne)""",
        "R_d_doc": f"""WITH {_stop_sums('CO2')},
line_sums AS (SELECT id_ligne, SUM(s) AS s, SUM(n) AS n, SUM(k) AS k FROM stop_sums JOIN Arret USING (id_arret) GROUP BY id_ligne)
SELECT immatriculation, type_vehicule, {r('CASE WHEN n = k THEN s / n END')} AS avg_co2 FROM line_sums JOIN Vehicule USING (id_ligne)""",
        "R_e_doc": f"""WITH {_stop_sums('Bruit')},
named AS (SELECT b.id_arret, q.nom FROM ArretQuartier b JOIN Quartier q USING (id_quartier) SEMI JOIN Arret a ON a.id_arret = b.id_arret),
means AS (SELECT nom, CASE WHEN SUM(n) = SUM(k) THEN SUM(s) / SUM(n) END AS v FROM named JOIN stop_sums USING (id_arret) GROUP BY nom)
SELECT nom AS quartier_nom, {r('v')} AS avg_bruit FROM means ORDER BY v DESC NULLS LAST, nom ASC NULLS FIRST LIMIT 5""",
        "R_f_doc": """SELECT DISTINCT nom_ligne FROM Ligne l WHERE EXISTS (
    SELECT 1 FROM Trafic t ANTI JOIN Incident i USING (id_trafic) WHERE t.id_ligne = l.id_ligne AND t.retard_minutes > 10)""",
        "R_g_doc": f"SELECT {r('COALESCE(AVG(CASE WHEN retard_minutes = 0 THEN 1e0 ELSE 0e0 END), 0)')} AS taux_sans_retard FROM Trafic",
        "R_h_doc": """WITH held AS (SELECT id_quartier FROM ArretQuartier SEMI JOIN Arret USING (id_arret))
SELECT nom AS quartier_nom, COUNT(*) AS arret_count FROM held JOIN Quartier USING (id_quartier) GROUP BY nom""",
        "R_i_doc": _correlation("vy", 1, r),
        "R_j_doc": f"""WITH {_stop_sums('Temperature')}, {_STOP_LINE}
SELECT nom_ligne, {r('CASE WHEN SUM(n) = SUM(k) THEN SUM(s) / SUM(n) END')} AS avg_temperature
FROM stop_sums JOIN stop_line USING (id_arret) GROUP BY id_ligne, nom_ligne""",
        "R_k_doc": f"""WITH {_DELAYS}, driven AS (SELECT id_chauffeur, SUM(s) / NULLIF(SUM(n), 0) AS v FROM Vehicule JOIN delays USING (id_ligne) GROUP BY id_chauffeur)
SELECT nom AS chauffeur_nom, {r('v')} AS avg_retard_minutes FROM driven LEFT JOIN Chauffeur USING (id_chauffeur)""",
        "R_l_doc": f"""WITH share AS (SELECT id_ligne, AVG(CASE WHEN type_vehicule = 'Electrique' THEN 1e0 ELSE 0e0 END) AS v FROM Vehicule GROUP BY id_ligne)
SELECT nom_ligne, {r('COALESCE(v, 0)')} AS taux_electrique FROM Ligne LEFT JOIN share USING (id_ligne) WHERE type = '{BUS_TYPE}'""",
        "R_m_doc": f"""WITH {level}, co2 AS (SELECT * FROM Capteur SEMI JOIN Arret USING (id_arret) WHERE type_capteur = 'CO2')
SELECT id_capteur, {r('latitude')} AS latitude, {r('longitude')} AS longitude, {r('valeur')} AS valeur,
    COALESCE(label, '{POLLUTION_BANDS[0][1]}') AS niveau_pollution
FROM co2 JOIN Mesure USING (id_capteur) LEFT JOIN levels ON valeur >= lo AND valeur < hi""",
        "R_n_doc": f"""WITH {delay}, {_DELAYS}
SELECT nom_ligne, COALESCE(label, '{DELAY_ELSE}') AS classification_retard
FROM delays JOIN Ligne USING (id_ligne) LEFT JOIN classes ON mean >= lo AND mean < hi""",
    }
    return rel, doc


REL, DOC = _reports(rounded)
RAW_REL, RAW_DOC = _reports(lambda expr: f"({expr})")

from oracle_products import PRODUCTS  # noqa: E402


def oracle_sql() -> dict[str, str]:
    out = {}
    for group in (REL, DOC, PRODUCTS):
        for k, sql in group.items():
            out[k] = with_views(sql)
    nested = {k.replace("_doc", "_nested"): with_views(sql) for k, sql in DOC.items()}
    return out | nested
