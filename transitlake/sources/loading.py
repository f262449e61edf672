"""Loading text tables with a reject channel.

``read_network`` fails on the first bad date. ``load_network`` goes on: a row whose line is malformed, or that has a date, a number or
a timestamp that does not parse, goes to the reject table with its table, text and reason; the others are loaded, typed.
A missing value is none of these. Both outcomes come from one parse of the text, so a row is in exactly one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake import schema as S
from transitlake.sources.binding import Later, Network

TS_FORMAT, DATE_FORMAT = "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"
_LINE = "_line"


def _parsed(name: str, kind: T.DataType) -> tuple[Column, str | None]:
    """The typed value (NULL where the text does not parse) and what a text that does not parse is called."""
    text = F.col(name)
    if isinstance(kind, T.TimestampNTZType):
        return F.try_to_timestamp(text, F.lit(TS_FORMAT)).cast("timestamp_ntz"), "bad timestamp"
    if isinstance(kind, T.DateType):
        return F.try_to_timestamp(text, F.lit(DATE_FORMAT)).cast("date"), "bad date"
    if isinstance(kind, T.StringType):
        return text, None
    return text.try_cast(kind), "not a number"


def parsed_table(spark: SparkSession, path: str, table: str, fmt: str = "csv") -> DataFrame:
    """(typed columns, _problems, _row): ``_problems`` lists (column, value, reason) and ``_row`` is the row's text as JSON."""
    schema = S.TABLES[table]
    text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in schema.fields], T.StructField(_LINE, T.StringType())])
    raw = (spark.read.schema(text).format(fmt).option("header", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", _LINE).option("columnPruning", False).load(path))
    item = "struct<column_name:string,value:string,reason:string>"
    problems = [F.when(F.col(_LINE).isNotNull(), F.struct(F.lit(None).cast("string").alias("column_name"), F.col(_LINE).alias("value"),
                                                          F.lit("malformed line").alias("reason")))]
    typed = []
    for f in schema.fields:
        value, wrong = _parsed(f.name, f.dataType)
        typed.append(value.alias(f.name))
        if wrong:
            bad = F.col(_LINE).isNull() & F.col(f.name).isNotNull() & value.isNull()
            problems.append(F.when(bad, F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).alias("value"), F.lit(wrong).alias("reason"))))
    return raw.select(*typed, F.array_compact(F.array(*problems)).cast(f"array<{item}>").alias("_problems"),
                      F.to_json(F.struct(*[f.name for f in schema.fields])).alias("_row"))


def load_table(spark: SparkSession, path: str, table: str, fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    """(loaded, rejects) of one table; rejects are (table_name, column_name, value, reason, row), a row for each problem."""
    parsed = parsed_table(spark, path, table, fmt)
    loaded = parsed.where(F.size("_problems") == 0).select([f.name for f in S.TABLES[table].fields])
    rejects = parsed.select(F.lit(table).alias("table_name"), F.inline("_problems"), F.col("_row").alias("row"))
    return loaded, rejects


def load_network(spark: SparkSession, root: str, fmt: str = "csv", tables: list[str] | None = None,
                 base: Network | None = None) -> tuple[Network, DataFrame]:
    """The network read from ``root/<Table>`` and the rejects of all its tables. With ``tables`` only those are read
    there and the others come from ``base``."""
    root, names = root.rstrip("/"), tables or list(S.TABLES)
    pairs = {n: load_table(spark, f"{root}/{n}", n, fmt) for n in names}
    rejects = None
    for _, r in pairs.values():
        rejects = r if rejects is None else rejects.unionByName(r)
    net = Network(**{n: pairs[n][0] if n in pairs else Later(lambda n=n: getattr(base, n)) for n in S.TABLES})
    return net, rejects
