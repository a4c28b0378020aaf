"""Ranks and running sums over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.plans.lineage import written
from quillmill.plans.sizing import row_count_at_most

#: Rows that one task may order.
ONE_TASK = 1_000_000


def ranked(df: DataFrame, order: list[Column], total: str | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """``df`` with ``rank`` (from 1) and, for a column ``total``, its running sum ``running``; the order must be total.

    Small tables, counted first, are ordered by one window. Larger ones are cut into ranges, written with the
    number of their range, and ranked within it after the counts and sums of the ranges before, one row for each range.
    """
    value = F.col(total) if total else F.lit(0)
    if row_count_at_most(df, one_task):
        w = Window.orderBy(*order)
        out = df.withColumn("rank", F.row_number().over(w))
        return out.withColumn("running", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))) if total else out
    cut = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    w = Window.partitionBy("_range").orderBy(*order)
    out = cut.join(F.broadcast(offsets), "_range").withColumn("rank", F.row_number().over(w) + F.col("_n0"))
    if total:
        out = out.withColumn("running", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_s0"))
    return out.drop("_range", "_n0", "_s0")
