"""The factored plans (aggregate before the many-to-many join) equal joins of the rows themselves, and
stay exact where sums over pairs outgrow a long."""

import math

import pytest
from pyspark.sql import functions as F

from helpers import close
from transitlake.plans import reports_doc as D
from transitlake.plans import reports_rel as R
from transitlake.operators.docviews import DocViews
from transitlake.sources.binding import bind_network, network_from_frames


@pytest.fixture(scope="module")
def net(spark):
    return bind_network(spark, "/root/testdata/sf0.001")


def co2_rows(net):
    return (net.Capteur.where("type_capteur = 'CO2'").join(net.Mesure, "id_capteur")
            .join(net.Arret.select("id_arret", "id_ligne"), "id_arret"))


def test_vehicle_means_equal_the_joined_rows(net):
    rows = co2_rows(net).join(net.Vehicule, "id_ligne")
    want = {r[0]: r[1] for r in rows.groupBy("immatriculation").agg(F.avg("valeur")).collect()}
    got = {r["immatriculation"]: r["avg_co2"] for r in R.report_d(net).collect()}
    assert want.keys() == got.keys() and all(close(want[k], got[k], 1e-9) for k in want)


def test_driver_means_equal_the_joined_rows(net):
    rows = net.Trafic.join(net.Vehicule, "id_ligne").join(net.Chauffeur, "id_chauffeur")
    want = {r[0]: r[1] for r in rows.groupBy("nom").agg(F.avg("retard_minutes")).collect()}
    got = {r["chauffeur_nom"]: r["avg_retard_minutes"] for r in R.report_k(net).collect()}
    assert want.keys() == got.keys() and all(close(want[k], got[k], 1e-9) for k in want)


def test_correlation_equals_the_pairs_themselves(net):
    day = F.to_date("horodatage")
    pairs = (co2_rows(net).select("id_ligne", day.alias("d"), "valeur")
             .join(net.Trafic.select("id_ligne", day.alias("d"), "retard_minutes"), ["id_ligne", "d"])
             .join(net.Ligne, "id_ligne"))
    sums = {}
    for r in pairs.select("nom_ligne", "valeur", "retard_minutes").collect():
        sums.setdefault(r[0], []).append((r[1], r[2]))
    want = {}
    for k, xy in sums.items():
        mx, my = (math.fsum(v[i] for v in xy) / len(xy) for i in (0, 1))
        vx, vy = (math.fsum((v[i] - m) ** 2 for v in xy) for i, m in ((0, mx), (1, my)))
        want[k] = math.fsum((x - mx) * (y - my) for x, y in xy) / math.sqrt(vx * vy) if vx > 1e-9 and vy > 1e-9 else None
    got = {r[0]: r[1] for r in R.report_i(net).collect()}
    assert want.keys() == got.keys() and all(close(want[k], got[k], 1e-6) for k in want)


def test_large_sums_neither_fail_nor_lose_digits(spark, net):
    """Delays so large that Sy exceeds 1e10 and its square a long: the truncated form is exact, the plain one answers."""
    n, m = 40, 3000
    mesure = spark.range(n).select(F.lit(0).cast("long").alias("id_capteur"), F.lit("2050-01-01 10:00:00").cast("timestamp_ntz").alias("horodatage"),
                                   (F.col("id") % 7).cast("double").alias("valeur"), F.lit("ppm").alias("unite"))
    trafic = spark.range(m).select(F.col("id").alias("id_trafic"), F.lit(0).cast("long").alias("id_ligne"),
                                   F.lit("2050-01-01 11:00:00").cast("timestamp_ntz").alias("horodatage"),
                                   (F.col("id") * 400_000 + F.col("id") % 13).alias("retard_minutes"), F.lit("x").alias("evenement"))
    frames = net.tables() | {"Mesure": mesure, "Trafic": trafic,
                             "Capteur": spark.createDataFrame([(0, 0, "CO2", 1.0, 1.0)], net.Capteur.schema),
                             "Arret": spark.createDataFrame([(0, "a", 1.0, 1.0, 0)], net.Arret.schema)}
    big = network_from_frames(frames)
    mom = R.correlation_moments_rel(big, exact=True).first()
    ys = [i * 400_000 + i % 13 for i in range(m)]
    assert int(mom["Sy"]) == n * sum(ys) > 10 ** 10 and int(mom["Syy"]) == n * sum(y * y for y in ys)
    xs = [i % 7 for i in range(n)]
    sx, sxx, total = sum(xs) * m, sum(x * x for x in xs) * m, n * m
    sy, syy = n * sum(ys), n * sum(y * y for y in ys)
    want = (sum(xs) * sum(ys) - sx * sy / total) / math.sqrt((sxx - sx * sx / total) * float(syy - sy * sy // total))
    assert close(R.report_i(big, truncate=True).first()["correlation"], want, 1e-6)
    assert abs(R.report_i(big).first()["correlation"]) < 1e-6 and abs(D.report_i(DocViews.from_network(big)).first()["correlation"]) < 1e-6
