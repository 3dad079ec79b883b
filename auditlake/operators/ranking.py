"""Dense numbers inside groups without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_in_group(df: DataFrame, group: str, key: Sequence[str], as_: str = "rank", slices: int | None = None) -> DataFrame:
    """A column ``as_``: 0, 1, 2 … inside each value of ``group``, without gaps.

    A group is cut into slices by a hash of ``key`` (which must tell the group's rows apart), rows
    are numbered inside their slice, and the slices' sizes give each slice its first number. A
    group with a third of all rows is thus numbered by many tasks. The order inside a group is
    arbitrary but the same at every run over the same rows.
    """
    slices = slices or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(*key), F.lit(slices)).cast("int"))
    sizes = cut.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(F.col(group).alias("_g"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(*key)) - 1
    numbered = cut.withColumn("_in", inside)
    joined = numbered.join(first, (F.col(group) == F.col("_g")) & (F.col("_slice") == F.col("_s")))
    return joined.withColumn(as_, (F.col("_first") + F.col("_in")).cast("long")).drop("_g", "_s", "_slice", "_first", "_in")


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median): the upper middle value of each group, exact at any size.

    Values are cut into slices of one unit; the slices' sizes tell which slice holds the middle, and
    only its rows are ordered, so no group is gathered in one task. Null values don't count; groups
    without a value have no row.
    """
    cut = df.where(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).alias("_v"), F.floor(value).alias("_b"))
    counts = cut.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    of = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_n").over(of.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("_first", before).withColumn("_k", F.floor(F.sum("_n").over(of) / 2))
    spot = placed.where((F.col("_k") >= F.col("_first")) & (F.col("_k") < F.col("_first") + F.col("_n"))).select(F.col("_g").alias("_sg"), F.col("_b").alias("_sb"), (F.col("_k") - F.col("_first")).alias("_at"))
    # equal values are one row with their number, so ties of a hot slice stay together
    inside = cut.join(spot, (F.col("_g") == F.col("_sg")) & (F.col("_b") == F.col("_sb"))).groupBy("_g", "_at", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(of.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = inside.withColumn("_upto", upto).where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_n")))
    return held.select(F.col("_g").alias(group), F.col("_v").alias("median"))
