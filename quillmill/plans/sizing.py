"""Decisions that depend on a measured size, so that nothing is broadcast without a bound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.plans.lineage import written

#: Rows of a narrow table that may be broadcast; about 64 bytes a row, so some 30 MB.
BROADCAST_ROWS = 500_000

#: A key is hot if it holds at least one row in this many; there are no more hot keys than that.
HOT_SHARE = 1000


def row_count_at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it needs to tell."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to have at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if row_count_at_most(df, rows) else df


def joined_in_parts(rows: DataFrame, table: DataFrame, key: str, few: int = BROADCAST_ROWS // 10) -> DataFrame:
    """The inner join of ``rows`` with a table that is broadcast, in parts of about ``few`` rows one after the other where it has more.

    For rows that are many more than their hits: they are made anew for each part and never shuffled or stored.
    """
    parts = -(-table.count() // few)
    if parts <= 1:
        return rows.join(F.broadcast(table), key)
    part = lambda k: rows.join(F.broadcast(table.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k)), key)
    return reduce(DataFrame.unionByName, [written(part(k), "part") for k in range(parts)])


def split_hot(counted: DataFrame, n: str, total: int, least: int = 10_000) -> Column:
    """Condition that marks the hot rows of a table of keys with their row counts ``n``.

    At most ``HOT_SHARE`` keys can fulfil it, whatever the size of the data, so the marked
    rows may be broadcast and the rest joined by shuffle without a task above total / HOT_SHARE.
    """
    return F.col(n) >= F.lit(max(least, total // HOT_SHARE))


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], n: str, keep: str | None = None, few: int = BROADCAST_ROWS // 10) -> DataFrame:
    """``rows`` with the columns of their key's one row in ``table``, null where it has none; ``n`` counts the key's rows.

    Keys that hold a thousandth of all rows are broadcast, at most a thousand of them, so no task gets a hot key; all others
    are joined by shuffle. A table of at most ``few`` rows, fewer where they are wide, is broadcast whole. The column ``n`` is dropped
    unless it is ``keep``.
    """
    if row_count_at_most(table, few):
        out = rows.join(F.broadcast(table), keys, "left")
    else:
        hot = split_hot(table, n, rows.count())
        mark = table.where(hot).withColumn("_hot", F.lit(True))
        probed = rows.join(F.broadcast(mark), keys, "left")
        cold = probed.where("_hot is null").select(rows.columns).join(table.where(~hot), keys, "left")
        out = probed.where("_hot").drop("_hot").unionByName(cold)
    return out if keep == n else out.drop(n)
