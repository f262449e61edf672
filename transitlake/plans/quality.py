"""Quality and parity: profile comparison (Q1), schema catalogue (Q2),
foreign-key integrity (Q3), result viewer (Q4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake import schema as S
from transitlake.sources import ordered
from transitlake.sources.binding import Network


def parity(report: str, rel: DataFrame, doc: DataFrame) -> DataFrame:
    """Q1: one row comparing the two profiles of a report: row counts and
    the rows found in only one of them (multiset difference, both ways). Each profile is evaluated once:
    both are tagged, united, and counted per distinct row.
    Doubles should be rounded by the caller to the tolerance wanted."""
    def tagged(df: DataFrame, r: int, d: int) -> DataFrame:
        return df.select(*df.columns, F.lit(r).alias("_r"), F.lit(d).alias("_d"))

    r, d = F.col("_r"), F.col("_d")
    each = tagged(rel, 1, 0).unionByName(tagged(doc, 0, 1)).groupBy(*rel.columns).agg(F.sum("_r").alias("_r"), F.sum("_d").alias("_d"))
    total = each.agg(F.sum(r).alias("n_rel"), F.sum(d).alias("n_doc"),
                     F.sum(F.greatest(r - d, F.lit(0))).alias("only_rel"), F.sum(F.greatest(d - r, F.lit(0))).alias("only_doc"))
    return total.unpivot([], ["n_rel", "n_doc", "only_rel", "only_doc"], "measure", "n").select(
        F.lit(report).alias("report"), "measure", F.coalesce("n", F.lit(0)).alias("n"))


def schema_catalogue(spark: SparkSession, net: Network) -> DataFrame:
    """Q2: (table, column, type, nullable, primary key) of every table."""
    rows = []
    for name, df in net.tables().items():
        pk = set(S.PRIMARY_KEYS[name])
        for f in df.schema.fields:
            rows.append((name, f.name, f.dataType.simpleString(), f.nullable, f.name in pk))
    return spark.createDataFrame(rows, "table string, column string, type string, nullable boolean, pk boolean")


def integrity(net: Network) -> DataFrame:
    """Q3: declared foreign keys, each with its number of orphan child rows
    (non-NULL key absent from the parent), computed by anti joins."""
    tables = net.tables()
    out = None
    for child, ccol, parent, pcol in S.FOREIGN_KEYS:
        keys = tables[parent].select(F.col(pcol).alias("_k"))
        # only (key, count) of the child moves; a left anti join needs no distinct on the parent
        used = tables[child].filter(F.col(ccol).isNotNull()).groupBy(F.col(ccol).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
        row = used.join(keys, "_k", "left_anti").agg(
            F.lit(f"{child}.{ccol}").alias("fk"), F.lit(f"{parent}.{pcol}").alias("ref"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("orphans"))
        out = row if out is None else out.unionByName(row)
    return out


def view_result(spark: SparkSession, path: str, page: int = 0, page_size: int = 20,
                schema: T.StructType | None = None) -> tuple[DataFrame, int]:
    """Q4: one page of a result (header CSV) in file order, and the number of its rows. The index beside the files (or one
    counted now) says which of them hold the page; no other is read. A missing file gives an empty frame."""
    return ordered.page(spark, path, page, page_size, schema).drop("rang"), ordered.count_rows(spark, path, schema)
