"""Running counts and sums over the whole order of a table, without bringing it, or a group of it, into one task.

Rows fall into buckets that are contiguous in the order; a table of one row for each bucket gives what lies ahead of it, and the
rest is counted inside each bucket. A place in the order is an integer or a line of a text source (file, split, row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import written

#: Rows of a bucket are at most 2 to the power of this.
BUCKET_BITS = 14
#: Rows that one task may take to put them in order.
MOST_AT_ONCE = 10_000


def bucket(df: DataFrame, place: str) -> Column:
    """The bucket of a place; it sorts as places do. Missing places come first, as their rows do."""
    none = F.lit(-1).cast("bigint")
    if isinstance(df.schema[place].dataType, StructType):
        row = F.shiftright(F.col(f"{place}.row"), BUCKET_BITS)
        return F.struct(F.coalesce(F.col(f"{place}.file"), F.lit("")).alias("file"), F.coalesce(F.col(f"{place}.split"), none).alias("split"), F.coalesce(row, none).alias("row"))
    return F.coalesce(F.shiftright(F.col(place).cast("bigint"), BUCKET_BITS), none)


def ahead(buckets: DataFrame, keys: list[str], value: str, into: str) -> DataFrame:
    """Adds the sum of value over the buckets (column `bucket`) before each, among those with equal keys."""
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return buckets.withColumn(into, F.coalesce(F.sum(value).over(order), F.lit(0)))


def numbered(df: DataFrame, group: str, places: list[str], into: str) -> DataFrame:
    """Adds the number (from 0) of each row in its group, in the order of places, missing ones first.

    Rows fall into ranges of the order, whatever the places are, and are written in it; the sizes of the ranges in each group give what lies ahead.
    """
    parts = df.repartitionByRange(group, *places).sortWithinPartitions(group, *places)
    parts = written(parts.withColumn("bucket", F.spark_partition_id()).withColumn("inside", F.monotonically_increasing_id()))
    bases = parts.groupBy(group, "bucket").agg(F.count("*").alias("n"), F.min("inside").alias("least"))
    bases = ahead(bases, [group], "n", "base").select(F.col(group).alias("of"), F.col("bucket").alias("in"), F.col("base") - F.col("least")).toDF("of", "in", "shift")
    # a row for each range and group: as many as tasks of one shuffle, and groups
    met = parts.join(F.broadcast(bases), parts[group].eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in")))
    return met.withColumn(into, F.col("shift") + F.col("inside")).drop("bucket", "inside", "of", "in", "shift")


def first_rows(df: DataFrame, order: list[Column], n: int, into: str) -> DataFrame:
    """The n first rows in an order without ties, numbered from 1.

    Few rows are picked by partial lists and one last task. More than MOST_AT_ONCE fall into ranges of the order; the sizes of the ranges give what
    lies ahead of each, ranges beyond n are left out, and the rest is numbered inside its range.
    """
    if n <= MOST_AT_ONCE:
        return df.orderBy(*order).limit(n).withColumn(into, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    parts = written(df.repartitionByRange(*order).withColumn("bucket", F.spark_partition_id()))
    bases = ahead(parts.groupBy("bucket").agg(F.count("*").alias("n")), [], "n", "base").where(F.col("base") < n).drop("n")
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    return parts.join(bases, "bucket").withColumn(into, (F.col("base") + inside).cast("bigint")).where(F.col(into) <= n).drop("bucket", "base")
