"""Cross-tabulations: the top of one entity within another, flows between attributes, heat maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _top_items(mentions: DataFrame, col: str, n: int) -> DataFrame:
    """The ``n`` most mentioned values; n rows, so they may be broadcast."""
    counted = mentions.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n"))
    return F.broadcast(counted.orderBy(F.col("_n").desc(), F.col(col)).limit(n).select(col))


def count_y_per_x(pairs: DataFrame, x: str, y: str, top_x: int, top_y: int) -> DataFrame:
    """(x, y, n): for the most frequent x, the most frequent y within each. ``pairs`` has a row for each pair."""
    kept = pairs.where(F.col(y).isNotNull()).join(_top_items(pairs, x, top_x), x)
    counted = kept.groupBy(x, y).agg(F.count("*").alias("n"))
    order = Window.partitionBy(x).orderBy(F.col("n").desc(), F.col(y))
    return counted.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top_y).select(F.col(x).alias("x"), F.col(y).alias("y"), "n")


def heatmap(pairs: DataFrame, x: str, y: str, top_x: int, top_y: int) -> DataFrame:
    """(x, y, n_docs): distinct papers of the most frequent x and the most frequent y."""
    kept = pairs.join(_top_items(pairs, x, top_x), x).join(_top_items(pairs, y, top_y), y)
    return kept.select("doc_id", x, y).distinct().groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n_docs"))


def flows(rows: DataFrame, attributes: list[str], top: int) -> DataFrame:
    """(level, source, target, n): flows between neighbouring attributes among the most frequent values of each.

    The values kept for an attribute are the most frequent among rows whose earlier attributes were kept.
    """
    kept, out = rows, None
    for level, a in enumerate(attributes):
        kept = kept.join(_top_items(kept, a, top), a)
        if level:
            step = kept.groupBy(F.col(attributes[level - 1]).alias("source"), F.col(a).alias("target")).agg(F.count("*").alias("n")).select(F.lit(level).alias("level"), "source", "target", "n")
            out = step if out is None else out.unionByName(step)
    if out is None:
        raise ValueError("flows need two attributes")
    return out


def pivoted(counts: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """A wide table for display; the columns are given, so no pass looks for them."""
    return counts.groupBy(row).pivot(column, columns).agg(F.sum(value))


def zipped(lists: DataFrame, x: str, y: str, key: str = "doc_id") -> DataFrame:
    """(key, x, y): pairs of two list columns, place by place if they are of equal length, else each with each."""
    place = F.transform(F.arrays_zip(F.col(x).alias("a"), F.col(y).alias("b")), lambda z: F.struct(z["a"].alias("x"), z["b"].alias("y")))
    each = F.flatten(F.transform(x, lambda a: F.transform(y, lambda b: F.struct(a.alias("x"), b.alias("y")))))
    return lists.select(key, F.inline(F.when(F.size(x) == F.size(y), place).otherwise(each)))
