"""Distributed positional numbering equals a window row_number."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from transitlake.operators.positional import with_position


def test_positions_match_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 1000).alias("v"),
                                     F.col("id"))
    got = with_position(df, ["g"], ["v", "id"], num_partitions=13)
    w = Window.partitionBy("g").orderBy("v", "id")
    want = df.withColumn("pos", F.row_number().over(w) - 1)
    assert got.select("g", "id", "pos").exceptAll(want.select("g", "id", "pos")).count() == 0
    assert got.count() == 5000


def test_global_positions(spark):
    df = spark.range(0, 1000).select((F.col("id") * 31 % 1000).alias("k"))
    got = with_position(df, [], ["k"], num_partitions=9)
    assert sorted(r[0] for r in got.filter(F.col("pos") == F.col("k")).select("k").collect()) == list(range(1000))


def test_hot_group_is_split(spark):
    df = spark.range(0, 20000).select(F.lit(1).alias("g"), F.col("id"))
    got = with_position(df, ["g"], ["id"], num_partitions=8)
    assert got.filter(F.col("pos") != F.col("id")).count() == 0
