"""The 11 transit tables as views over the driver's parquet tables.

The reference reads a SQLite file that is not shipped; the driver supplies
TPC-H-like tables instead. Each entity below is a pure projection/join of
those tables (FIXTURES.md section 4), so every report's work grows with the
input. All reads go through ``spark.read.parquet`` so Catalyst prunes
columns and pushes filters into the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake import schema as S
from transitlake.functions.calc import parse_ts_strict

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Fixed values of the bindings: line type read as "Bus" in the reports.
BUS_TYPE = "EUROPE"


# Declared schemas of the driver tables (as written by the generator). Reading
# with them skips footer inference and pins the timestamps to timestamp_ntz
# (wall-clock values), whatever the session's time zone or inference setting.
DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(DRIVER_SCHEMAS[name]) if name in DRIVER_SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Later:
    """A frame to be built when it is first used."""

    def __init__(self, build: Callable[[], DataFrame]):
        self.build = build


class OnDemand:
    """Fields may be given as ``Later``: each is built on first use and kept, so that a report pays for the
    frames it reads and for no others."""

    def __getattribute__(self, name: str):
        value = object.__getattribute__(self, name)
        if isinstance(value, Later):
            value = value.build()
            object.__setattr__(self, name, value)
        return value


@dataclass
class Network(OnDemand):
    """The relational profile: one DataFrame per table."""
    Ligne: DataFrame
    Quartier: DataFrame
    Arret: DataFrame
    ArretQuartier: DataFrame
    Chauffeur: DataFrame
    Vehicule: DataFrame
    Horaire: DataFrame
    Capteur: DataFrame
    Mesure: DataFrame
    Trafic: DataFrame
    Incident: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def register(self, spark: SparkSession) -> None:
        for name, df in self.tables().items():
            df.createOrReplaceTempView(name)


def _conform(df: DataFrame, table: str) -> DataFrame:
    """Project onto the table contract (order and types)."""
    return df.to(T.StructType([T.StructField(f.name, f.dataType) for f in S.TABLES[table].fields]))


def _stop_lat(key):
    return F.lit(48.8) + (key % 100) / F.lit(1000.0)


def _stop_lon(key):
    return F.lit(2.3) + (key % 77) / F.lit(1000.0)


def bind_network(spark: SparkSession, sf_dir: str) -> Network:
    """The 11 tables over ``sf_dir``, bound anew on each call, so that files added since are seen. A table is bound,
    and a driver table read, when the first report asks for it."""
    read: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in read:
            read[name] = read_table(spark, sf_dir, name)
        return read[name]

    return Network(**{n: Later(lambda n=n: _conform(BINDINGS[n](table), n)) for n in S.TABLES})


Tables = Callable[[str], DataFrame]


def _ligne(t: Tables) -> DataFrame:
    nation, region = t("nation"), t("region")
    return (nation.join(region, nation.n_regionkey == region.r_regionkey)
             .select(F.col("n_nationkey").alias("id_ligne"), F.col("n_name").alias("nom_ligne"),
                     F.col("r_name").alias("type"),
                     (F.col("n_nationkey").cast("long") * 100).alias("frequentation_moyenne")))


def _quartier(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return (t("part")
                .select(size.alias("id_quartier"),
                        F.concat(F.lit("Quartier-"), size.cast("string")).alias("nom"),
                        F.when(size % 17 == 0, "POLYGON((x y, 1 2))").otherwise(F.concat(F.lit("POLYGON(("), (size + 2).cast("string"), F.lit(" 48,"),
                                 (size + 3).cast("string"), F.lit(" 48,"),
                                 (size + 3).cast("string"), F.lit(" 49))"))).alias("geojson"))
                .distinct())


def _arret(t: Tables) -> DataFrame:
    sk = F.col("s_suppkey")
    return t("supplier").select(sk.alias("id_arret"), F.concat(F.lit("Arret "), (sk % 40).cast("string")).alias("nom"),
                            _stop_lat(sk).alias("latitude"), _stop_lon(sk).alias("longitude"),
                            F.col("s_nationkey").alias("id_ligne"))


def _arret_quartier(t: Tables) -> DataFrame:
    supplier, sk = t("supplier"), F.col("s_suppkey")
    return (supplier.select(sk.alias("id_arret"), (1 + sk % 50).alias("id_quartier"))
                      .union(supplier.select(sk, 1 + (sk * 7 + 3) % 50))
                      .distinct())


def _chauffeur(t: Tables) -> DataFrame:
    ck = F.col("c_custkey")
    return (t("customer").select((ck % 200).alias("id_chauffeur"))
                 .distinct()
                 .select("id_chauffeur",
                         F.concat(F.lit("Chauffeur "), F.col("id_chauffeur").cast("string")).alias("nom"),
                         F.lit("2045-01-01").cast("date").alias("date_embauche")))


def _vehicule(t: Tables) -> DataFrame:
    ck = F.col("c_custkey")
    return t("customer").select(
        ck.alias("id_vehicule"), F.col("c_name").alias("immatriculation"), F.col("c_nationkey").alias("id_ligne"),
        (ck % 200).alias("id_chauffeur"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Electrique")
         .when(F.col("c_mktsegment") == "MACHINERY", "Hybride").otherwise("Diesel").alias("type_vehicule"),
        (40 + 10 * (ck % 5)).alias("capacite"))


def _horaire(t: Tables) -> DataFrame:
    return t("events").select(
        F.col("event_id").alias("id_horaire"), F.col("user_id").alias("id_arret"),
        (F.col("event_id") % 150).alias("id_vehicule"), F.col("ts").alias("heure_prevue"),
        F.col("ts").alias("heure_effective"), (F.floor("value").cast("long") % 80).alias("passagers_estimes"))


def _capteur(t: Tables) -> DataFrame:
    sk, kind = F.col("s_suppkey"), F.col("k")
    return (t("supplier").select(sk, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
               .select((sk * 3 + kind).alias("id_capteur"), sk.alias("id_arret"),
                       F.when(kind == 0, "CO2").when(kind == 1, "Bruit").otherwise("Temperature").alias("type_capteur"),
                       _stop_lat(sk).alias("latitude"), _stop_lon(sk).alias("longitude")))


def _mesure(t: Tables) -> DataFrame:
    ln3, q = F.col("l_linenumber") % 3, F.col("l_quantity")
    return t("lineitem").select(
        (F.col("l_suppkey") * 3 + ln3).alias("id_capteur"), F.col("l_shipdate").alias("horodatage"),
        F.when(ln3 == 0, 300 + q * 2 + (F.col("l_suppkey") % 7) * 40).when(ln3 == 1, 50 + q / 2).otherwise(10 + q / 5).alias("valeur"),
        F.when(ln3 == 0, "ppm").when(ln3 == 1, "dB").otherwise("C").alias("unite"))


def _trafic(t: Tables) -> DataFrame:
    orders, customer = t("orders"), t("customer")
    return (orders.join(customer, orders.o_custkey == customer.c_custkey)
              .select(F.col("o_orderkey").alias("id_trafic"), F.col("c_nationkey").alias("id_ligne"),
                      F.col("o_orderdate").alias("horodatage"),
                      F.when(F.col("o_orderkey") % 3 == 0, F.lit(0).cast("long"))
                       .otherwise(F.floor("o_totalprice").cast("long") % (8 + 2 * (F.col("c_nationkey") % 9))).alias("retard_minutes"),
                      F.col("o_orderpriority").alias("evenement")))


def _incident(t: Tables) -> DataFrame:
    return (t("lineitem").filter(F.col("l_returnflag") == "R")
                .select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id_incident"),
                        F.col("l_orderkey").alias("id_trafic"), F.col("l_linestatus").alias("description"),
                        (1 + F.col("l_linenumber") % 5).alias("gravite"), F.col("l_shipdate").alias("horodatage")))


BINDINGS: dict[str, Callable[[Tables], DataFrame]] = {
    "Ligne": _ligne, "Quartier": _quartier, "Arret": _arret, "ArretQuartier": _arret_quartier, "Chauffeur": _chauffeur,
    "Vehicule": _vehicule, "Horaire": _horaire, "Capteur": _capteur, "Mesure": _mesure, "Trafic": _trafic, "Incident": _incident}


def network_from_frames(frames: dict[str, DataFrame]) -> Network:
    """Build a Network from frames already in table shape (tests, other loaders)."""
    return Network(**{n: _conform(frames[n], n) for n in S.TABLES})


def write_network(net: Network, root: str, max_records_per_file: int = 1_000_000) -> None:
    """Materialise the 11 tables under ``root/<Table>`` (parquet, overwrite),
    e.g. once per load into the shared folder; ``read_network`` reads them back."""
    for name, df in net.tables().items():
        df.write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file).parquet(
            f"{root.rstrip('/')}/{name}")


def read_network(spark: SparkSession, root: str, fmt: str = "parquet") -> Network:
    """Read the 11 tables from ``root/<Table>`` with their declared schemas (S1). Text formats hold dates as
    text: they are parsed strictly (F4), so that a malformed one fails the load."""
    def one(name: str, schema) -> DataFrame:
        path = f"{root.rstrip('/')}/{name}"
        if fmt in ("parquet", "orc"):
            return spark.read.schema(schema).format(fmt).load(path)
        dated = {f.name: f.dataType for f in schema.fields if isinstance(f.dataType, (T.TimestampNTZType, T.DateType))}
        text = T.StructType([T.StructField(f.name, T.StringType()) if f.name in dated else f for f in schema.fields])
        raw = spark.read.schema(text).format(fmt).option("header", True).option("mode", "FAILFAST").load(path)
        return raw.select([(parse_ts_strict(f.name) if isinstance(dated[f.name], T.TimestampNTZType)
                            else F.to_date(f.name, "yyyy-MM-dd")).alias(f.name) if f.name in dated else F.col(f.name)
                           for f in schema.fields])

    return Network(**{n: Later(lambda n=n, s=s: one(n, s)) for n, s in S.TABLES.items()})


def read_network_jdbc(spark: SparkSession, url: str, properties: dict | None = None,
                      partitions: dict[str, dict] | None = None) -> Network:
    """S1 over JDBC: ``SELECT *`` of the 11 tables with the declared column
    types (``customSchema``); needs the database's JDBC driver on the
    classpath. ``properties`` hold for every table; ``partitions`` gives a table's own
    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``, without
    which it is read by one task."""
    out = {}
    for name, schema in S.TABLES.items():
        custom = ", ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in schema.fields)
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name) \
            .option("customSchema", custom)
        for k, v in ((properties or {}) | (partitions or {}).get(name, {})).items():
            reader = reader.option(k, v)
        out[name] = reader.load()
    return network_from_frames(out)


# Portable SQL of the same bindings (FIXTURES.md section 4), used by the
# DuckDB oracle. Fixed values, kept verbatim.
VIEW_SQL: dict[str, str] = {
    "Ligne": "SELECT CAST(n_nationkey AS BIGINT) AS id_ligne, n_name AS nom_ligne, r_name AS type, "
             "CAST(100 * n_nationkey AS BIGINT) AS frequentation_moyenne "
             "FROM nation JOIN region ON n_regionkey = r_regionkey",
    "Quartier": "SELECT DISTINCT CAST(p_size AS BIGINT) AS id_quartier, concat('Quartier-', p_size) AS nom, "
                "CASE WHEN p_size % 17 = 0 THEN 'POLYGON((x y, 1 2))' ELSE "
                "concat('POLYGON((', 2 + p_size, ' 48,', 3 + p_size, ' 48,', 3 + p_size, ' 49))') END AS geojson FROM part",
    "Arret": "SELECT s_suppkey AS id_arret, concat('Arret ', s_suppkey % 40) AS nom, "
             "48.8e0 + (s_suppkey % 100) / 1000e0 AS latitude, 2.3e0 + (s_suppkey % 77) / 1000e0 AS longitude, "
             "CAST(s_nationkey AS BIGINT) AS id_ligne FROM supplier",
    "ArretQuartier": "SELECT s_suppkey AS id_arret, 1 + s_suppkey % 50 AS id_quartier FROM supplier "
                     "UNION SELECT s_suppkey, 1 + (s_suppkey * 7 + 3) % 50 FROM supplier",
    "Chauffeur": "SELECT DISTINCT c_custkey % 200 AS id_chauffeur, concat('Chauffeur ', c_custkey % 200) AS nom, "
                 "DATE '2045-01-01' AS date_embauche FROM customer",
    "Vehicule": "SELECT c_custkey AS id_vehicule, c_name AS immatriculation, CAST(c_nationkey AS BIGINT) AS id_ligne, "
                "c_custkey % 200 AS id_chauffeur, CASE c_mktsegment WHEN 'BUILDING' THEN 'Electrique' "
                "WHEN 'MACHINERY' THEN 'Hybride' ELSE 'Diesel' END AS type_vehicule, "
                "40 + 10 * (c_custkey % 5) AS capacite FROM customer",
    "Horaire": "SELECT event_id AS id_horaire, user_id AS id_arret, event_id % 150 AS id_vehicule, "
               "ts AS heure_prevue, ts AS heure_effective, "
               "CAST(floor(value) AS BIGINT) % 80 AS passagers_estimes FROM events",
    "Capteur": "SELECT s_suppkey * 3 + k AS id_capteur, s_suppkey AS id_arret, CASE k WHEN 0 THEN 'CO2' "
               "WHEN 1 THEN 'Bruit' ELSE 'Temperature' END AS type_capteur, "
               "48.8e0 + (s_suppkey % 100) / 1000e0 AS latitude, 2.3e0 + (s_suppkey % 77) / 1000e0 AS longitude "
               "FROM supplier CROSS JOIN (VALUES (0), (1), (2)) AS kk(k)",
    "Mesure": "SELECT l_suppkey * 3 + l_linenumber % 3 AS id_capteur, l_shipdate AS horodatage, "
              "CASE l_linenumber % 3 WHEN 0 THEN 300 + l_quantity * 2 + (l_suppkey % 7) * 40 WHEN 1 THEN 50 + l_quantity / 2 "
              "ELSE 10 + l_quantity / 5 END AS valeur, CASE l_linenumber % 3 WHEN 0 THEN 'ppm' "
              "WHEN 1 THEN 'dB' ELSE 'C' END AS unite FROM lineitem",
    "Trafic": "SELECT o_orderkey AS id_trafic, CAST(c_nationkey AS BIGINT) AS id_ligne, o_orderdate AS horodatage, "
              "CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) % (8 + 2 * (c_nationkey % 9)) END "
              "AS retard_minutes, o_orderpriority AS evenement FROM orders JOIN customer ON o_custkey = c_custkey",
    "Incident": "SELECT l_orderkey * 8 + l_linenumber AS id_incident, l_orderkey AS id_trafic, "
                "l_linestatus AS description, 1 + l_linenumber % 5 AS gravite, l_shipdate AS horodatage "
                "FROM lineitem WHERE l_returnflag = 'R'",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the binding views as CTEs (DuckDB oracle text)."""
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in VIEW_SQL.items())
    head = sql.lstrip()
    if head[:4].upper() == "WITH":
        return f"WITH {ctes},\n{head[4:].lstrip()}"
    return f"WITH {ctes}\n{sql}"
