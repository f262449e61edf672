"""District documents: from GeoJSON (M5), from WKT text (M6), the
synthetic-to-real pairing (M8) and its upsert into the collection (M9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake import schema as S
from transitlake.operators.positional import with_position
from transitlake.sources.collections import upsert, upsert_collection
from transitlake.sources.jsonsplit import json_records, numbered_over_files

# GeoJSON property names of the district file.
PROP_NAME, PROP_CODE, PROP_ARR, PROP_SURFACE, PROP_PERIMETER = "l_qu", "c_qu", "c_ar", "surface", "perimetre"

FEATURE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", T.StructType([
        T.StructField(PROP_NAME, T.StringType()), T.StructField(PROP_CODE, T.StringType()),
        T.StructField(PROP_ARR, T.IntegerType()), T.StructField(PROP_SURFACE, T.DoubleType()),
        T.StructField(PROP_PERIMETER, T.DoubleType())])),
    T.StructField("geometry", S.POLYGON)])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON FeatureCollections → one row per feature with its 0-based position, over all files of
    ``path`` in file order. A collection is cut into features by ``jsonsplit``, so a large file is read by many tasks."""
    rows = numbered_over_files(json_records(spark, path, "features")).select("idx", F.from_json("json", FEATURE).alias("f"))
    return rows.select("idx", F.col("f.properties").alias("p"), F.col("f.geometry").alias("geometry"))


FEATURES_PER_FILE = 1 << 14


def write_features(features: DataFrame, path: str, per_file: int = FEATURES_PER_FILE) -> None:
    """Features (idx, p, geometry) as FeatureCollections in ``path``: a file for each ``per_file`` places, with a line for each feature in
    order, the first one after the head, the last one before the foot. The files are in the features' order too, which is how
    ``read_features`` reads them; each is written by one task, which sees no other's features."""
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("p").alias("properties"), "geometry"))
    lines = features.select("idx", F.lpad(F.floor(F.col("idx") / per_file).cast("string"), 12, "0").alias("file"), feature.alias("value"))
    own = Window.partitionBy("file").orderBy("idx")
    first, last = F.lag("idx").over(own).isNull(), F.lead("idx").over(own).isNull()
    head = F.when(first, '{"type": "FeatureCollection", "features": [\n').otherwise(",")
    framed = lines.select("file", "idx", F.concat(head, "value", F.when(last, "\n]}").otherwise("")).alias("value"))
    framed.sortWithinPartitions("file", "idx").select("file", "value").write.mode("overwrite").partitionBy("file").text(path)


def features_of(quartiers: DataFrame) -> DataFrame:
    """District documents as the rows of a FeatureCollection, in id order (properties that a document lacks stay NULL)."""
    props = F.struct(F.col("nom").alias(PROP_NAME), F.col("code_quartier").alias(PROP_CODE), F.col("arrondissement").alias(PROP_ARR),
                     F.col("surface").alias(PROP_SURFACE), F.col("perimetre").alias(PROP_PERIMETER))
    return with_position(quartiers, [], ["id_quartier"], name="idx").select("idx", props.alias("p"), "geometry")


def quartiers_from_geojson(features: DataFrame) -> DataFrame:
    """M5: one district per feature, id = position + 1, defaults for missing
    properties, flagged as real."""
    pid = (F.col("idx") + 1).cast("long")
    name = F.coalesce(F.col(f"p.{PROP_NAME}"), F.concat(F.lit("Quartier-"), pid.cast("string")))
    return features.select(
        pid.alias("id_quartier"), name.alias("nom"), name.alias("nom_officiel"),
        F.coalesce(F.col(f"p.{PROP_CODE}"), F.lit("")).alias("code_quartier"),
        F.coalesce(F.col(f"p.{PROP_ARR}"), F.lit(0)).alias("arrondissement"),
        "geometry",
        F.coalesce(F.col(f"p.{PROP_SURFACE}"), F.lit(0.0)).alias("surface"),
        F.coalesce(F.col(f"p.{PROP_PERIMETER}"), F.lit(0.0)).alias("perimetre"),
        F.lit(True).alias("is_real_paris"))


def _wkt_ring(text: Column) -> Column:
    """POLYGON((x y, x y, ...)) → array of [x, y] (NULL entries where a number
    does not parse). Points without a blank are skipped, extra ordinates are
    ignored."""
    body = F.replace(F.replace(text, F.lit("POLYGON(("), F.lit("")), F.lit("))"), F.lit(""))
    pts = F.transform(F.split(body, ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    pts = F.filter(pts, lambda p: p.contains(" "))
    return F.transform(pts, lambda p: F.transform(F.slice(F.split(p, r"\s+"), 1, 2),
                                                  lambda x: x.try_cast("double")))


def quartiers_from_wkt(quartier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M6: fallback build from the Quartier table. WKT POLYGON text becomes a
    GeoJSON Polygon whose ring is closed (first point appended when it
    differs from the last); other text is read as GeoJSON. Rows that cannot
    be converted go to the reject table (id, text, reason) instead of
    stopping the job. Returns (documents, rejects)."""
    g = F.col("geojson")
    is_wkt = g.startswith("POLYGON")
    ring = _wkt_ring(g)
    bad_point = F.exists(ring, lambda pt: pt.isNull() | (F.size(pt) < 2) | F.exists(pt, lambda x: x.isNull()))
    closed = F.when(F.get(ring, 0) != F.get(ring, F.size(ring) - 1),
                    F.concat(ring, F.array(F.get(ring, 0)))).otherwise(ring)
    as_json = F.from_json(g, S.POLYGON)
    staged = quartier.select(
        "id_quartier", "nom", "geojson",
        F.when(is_wkt, F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates")))
         .otherwise(as_json).alias("geometry"),
        F.when(g.isNull(), "no geometry text")
         .when(is_wkt & (F.size(ring) == 0), "empty ring")
         .when(is_wkt & bad_point, "unparseable coordinate")
         .when(~is_wkt & (as_json.isNull() | as_json["coordinates"].isNull()), "not a GeoJSON polygon")
         .alias("reason"))
    docs = staged.filter(F.col("reason").isNull()).select(
        "id_quartier", "nom", F.lit(None).cast("string").alias("nom_officiel"),
        F.lit(None).cast("string").alias("code_quartier"), F.lit(None).cast("int").alias("arrondissement"),
        "geometry", F.lit(None).cast("double").alias("surface"), F.lit(None).cast("double").alias("perimetre"),
        F.lit(False).alias("is_real_paris"))
    rejects = staged.filter(F.col("reason").isNotNull()).select("id_quartier", "geojson", "reason")
    return docs, rejects


def quartier_mapping(quartier: DataFrame, features: DataFrame) -> DataFrame:
    """M8: pair the i-th synthetic district (table order = id order) with the
    i-th feature; pairs stop at the shorter list. Columns: id_quartier,
    nom_synthetique, nom_reel ('' when absent), arrondissement (0 when
    absent), index_geojson."""
    synth = with_position(quartier.select("id_quartier", "nom"), [], ["id_quartier", "nom"], name="i")
    real = features.select(F.col("idx").alias("i"), F.coalesce(F.col(f"p.{PROP_NAME}"), F.lit("")).alias("nom_reel"),
                           F.coalesce(F.col(f"p.{PROP_ARR}"), F.lit(0)).alias("arrondissement"))
    return (synth.join(real, "i")
            .select("id_quartier", F.col("nom").alias("nom_synthetique"), "nom_reel", "arrondissement",
                    F.col("i").alias("index_geojson"))
            .orderBy("id_quartier"))


def mapping_json_lines(mapping: DataFrame) -> DataFrame:
    """One JSON object per key, ``{"<id>": {...}}``, built on the executors."""
    body = F.to_json(F.struct("nom_synthetique", "nom_reel", "arrondissement", "index_geojson"))
    return mapping.select(F.concat(F.lit('{"'), F.col("id_quartier").cast("string"), F.lit('": '), body,
                                   F.lit("}")).alias("value"))


def mapping_updates(mapping: DataFrame, features: DataFrame) -> DataFrame:
    """What M9 sets on each mapped district: nom_synthetique, nom_reel, arrondissement and the feature's geometry."""
    geo = features.select(F.col("idx").alias("index_geojson"), "geometry")
    return mapping.join(geo, "index_geojson").select(
        "id_quartier", "nom_synthetique", "nom_reel", F.col("arrondissement").cast("int").alias("arrondissement"), "geometry")


def apply_mapping(quartiers: DataFrame, mapping: DataFrame, features: DataFrame) -> DataFrame:
    """M9 on frames: the districts after the upsert (insert when missing)."""
    return upsert(quartiers, mapping_updates(mapping, features), "id_quartier")


def apply_mapping_stored(root: str, mapping: DataFrame, features: DataFrame) -> list[int]:
    """M9 on the stored district collection: rewrites the parts that hold mapped districts and returns them."""
    return upsert_collection(mapping_updates(mapping, features), root)
