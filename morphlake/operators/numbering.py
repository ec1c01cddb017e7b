"""Row numbers over whole tables without a task that holds all rows, and ids packed from several numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphlake.sources.storage import cut


def numbered(rows: DataFrame, order: Sequence[Column], name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: 1, 2, ... over the whole table in ``order``.

    Rows are range-partitioned by the order, numbered inside each range, and moved by the number of rows of the ranges
    before, which is a sum over one row a range. Rows equal in the order get neighbouring numbers in any order.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    offsets = offsets.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))  # a row a range
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    out = ranged.withColumn("__inside", inside).join(F.broadcast(offsets), "__range")
    return out.withColumn(name, (F.col("__before") + F.col("__inside")).cast("bigint")).drop("__range", "__before", "__inside")


def summed_before(rows: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before in ``order``, which is different for each; ranges as in ``numbered``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("__range").agg(F.sum(value).alias("__n"))
    offsets = offsets.select("__range", F.coalesce(F.sum("__n").over(before(Window.partitionBy(F.lit(0)).orderBy("__range"))), F.lit(0)).alias("__before"))  # a row a range
    inside = F.coalesce(F.sum(value).over(before(Window.partitionBy("__range").orderBy(*order))), F.lit(0))
    out = ranged.withColumn("__inside", inside).join(F.broadcast(offsets), "__range")
    return out.withColumn(name, (F.col("__before") + F.col("__inside")).cast("bigint")).drop("__range", "__before", "__inside")


def packed(*parts: tuple[Column | str, int]) -> Column:
    """One long from (number, how many values it may have), the first the highest; a number out of its range raises."""
    out: Column = F.lit(0).cast("bigint")
    for value, size in parts:
        column = (F.col(value) if isinstance(value, str) else value).cast("bigint")
        fits = column.isNull() | ((column >= 0) & (column < size))
        out = out * F.lit(size) + F.when(fits, column).otherwise(F.raise_error(F.lit(f"an id of {size} or more can't be packed")).cast("bigint"))
    return out
