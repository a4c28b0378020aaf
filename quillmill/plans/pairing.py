"""Joins in which a key may be hot on both sides: its rows meet block by block, so no task holds a whole hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.plans.lineage import checkpointed
from quillmill.plans.sizing import BROADCAST_ROWS, row_count_at_most, split_hot

#: Rows of one key on one side that may meet those of the other in one task.
PAIR_BLOCK = 2_000


def split_join(left: DataFrame, right: DataFrame, keys: list[str], block: int = PAIR_BLOCK) -> DataFrame:
    """The inner join on ``keys``, with keys of more than ``block`` rows on either side cut into blocks that meet each other.

    Rows of such a key get the number of their block by their hash and are sent to every block of the other side; all other
    rows are joined as they are. Both tables are read twice, so they should be cheap to read or cut before.
    """
    counted = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    wide = counted(left, "_l").join(counted(right, "_r"), keys).where((F.col("_l") > block) | (F.col("_r") > block))
    wide = checkpointed(wide.select(*keys, "_l", "_r", F.ceil(F.col("_l") / block).alias("_nl"), F.ceil(F.col("_r") / block).alias("_nr")))
    if wide.isEmpty():
        return left.join(right, keys)
    few = row_count_at_most(wide, BROADCAST_ROWS)

    def numbered(df: DataFrame, rows: str) -> DataFrame:
        table = wide.select(*keys, rows, "_nl", "_nr")
        if few:
            return df.join(F.broadcast(table), keys, "left").drop(rows)
        hot = split_hot(table, rows, df.count())  # a thousand keys at most
        probed = df.join(F.broadcast(table.where(hot)), keys, "left").drop(rows)
        rest = probed.where("_nl is null").drop("_nl", "_nr").join(table.where(~hot).drop(rows), keys, "left")
        return probed.where("_nl is not null").unionByName(rest)

    def sent(df: DataFrame, rows: str, own: str, other: str) -> DataFrame:
        mine: Column = F.coalesce(F.pmod(F.xxhash64(*df.columns), F.col(f"_n{own}")), F.lit(0))
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(f"_n{other}", F.lit(1)).cast("bigint") - 1))
        return numbered(df, rows).select(*df.columns, mine.cast("bigint").alias(f"_b{own}"), each.alias(f"_b{other}"))

    return sent(left, "_l", "l", "r").join(sent(right, "_r", "r", "l"), [*keys, "_bl", "_br"]).drop("_bl", "_br")
