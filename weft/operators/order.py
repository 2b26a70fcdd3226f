"""Numbers in an order over all rows, without a task that gets them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.plans.lineage import cut


def _ranges(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows dealt by ranges of the order, with their range; a table, so that a range is what one task has written."""
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(many, *order).withColumn("_range", F.spark_partition_id()))


def _before(per: DataFrame, value: str) -> DataFrame:
    """(_range, _before): sums of a value over the earlier ranges; as many rows as shuffle partitions."""
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("_range", F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias("_before"))


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """rows with their place, 1 and more, in an order without ties: places inside ranges of it, and the rows of earlier ranges."""
    dealt = _ranges(rows, *order)
    before = _before(dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")), "n")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(before), "_range").withColumn(name, (place + F.col("_before")).cast("int")).drop("_range", "_before")


def min_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with 1 + the number of rows of a larger value; nulls are smallest and rank as one value."""
    values = rows.groupBy(F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    order = F.col("_value").desc_nulls_last()
    dealt = _ranges(values, order)
    before = _before(dealt.groupBy("_range").agg(F.sum("_n").alias("n")), "n")
    upto = F.sum("_n").over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    ranked = dealt.join(F.broadcast(before), "_range").select("_value", (upto - F.col("_n") + F.col("_before") + 1).cast("int").alias(name))
    return rows.join(ranked, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")
