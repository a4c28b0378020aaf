"""Items that stand together (problem 4): a heavy-light decomposition of pair counting.

1. Items are counted by rows, which bounds their number of works from above; items that cannot reach the least number
   of shared works are dropped, exactly. What is left is numbered, the most frequent items of each field first.
2. Rows are sent once, as two numbers, to the block of their work. Within a block, in Arrow batches of whole blocks:
   pairs of heavy items are counted by ANDing the rows of a bit matrix (item x work) and counting ones; pairs of
   light items are hashed and counted; mixed pairs are found by probing the work's list of heavy items.
3. Works with very many items are cut into parts, and each two parts of a work meet in a task of their own.
4. Counts of blocks and parts are added up, and lift and the least count decide.

The number of heavy items is a parameter, so the bit matrix has a fixed width however skewed the items are. Blocks are
made of works, so a frequent item is spread over all of them. The number of blocks grows with the data, that of partitions has
a bound: a task reads many blocks, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.plans import BROADCAST_ROWS, broadcast_if_small, checkpointed, row_count_at_most, written

#: Heavy items of each field.
HEAVY = 192

#: Rows of a block of works, about; and partitions that blocks are spread over, at most.
BLOCK_ROWS, PARTITIONS = 200_000, 20_000

#: Rows of a work beyond which it is cut, and about as many are in each part; parts make no more pairs than its square.
WIDE = 2_000

#: An item's code holds its number, above this many bits, its field's number, and in the last bit whether it is heavy.
SHIFT = 20
FIELD_MASK = (1 << (SHIFT - 1)) - 1

#: Pairs that are counted at once.
PAIR_MEMORY = 4_000_000


def _pairs_of_light(work: np.ndarray, item: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (smaller, larger) of items of one work, some at a time; rows are sorted by work and item."""
    a, b, held = [item[:0]], [item[:0]], 0
    step = 1
    while True:
        same = np.flatnonzero(work[step:] == work[:-step]) if step < len(work) else ()
        if not len(same):
            break
        a.append(item[same])
        b.append(item[same + step])
        held += len(same)
        if held > PAIR_MEMORY:
            yield np.concatenate(a), np.concatenate(b)
            a, b, held = [item[:0]], [item[:0]], 0
        step += 1
    yield np.concatenate(a), np.concatenate(b)


def _counted(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    keys, n = np.unique(a.astype(np.int64) << 32 | b.astype(np.int64), return_counts=True)
    return pd.DataFrame({"a": keys >> 32, "b": keys & 0xFFFFFFFF, "n": n})


def count_block(work: np.ndarray, item: np.ndarray, field: np.ndarray, heavy: np.ndarray) -> pd.DataFrame:
    """(a, b, n) of the pairs a < b of one field within a work, and (a, a, n) for the works of each item.

    ``field`` and ``heavy`` say of each item's number to which field it belongs and whether it is heavy.
    """
    keys = np.unique(np.stack([work, item]), axis=1) if len(work) else np.stack([work, item])
    work, item = keys[0], keys[1]
    out = [_counted(item, item)]
    for f in np.unique(field[item]):
        own = field[item] == f
        w, x = work[own], item[own]
        big = heavy[x]
        out += [_counted(*pairs) for pairs in _pairs_of_light(w[~big], x[~big])]
        if not big.any():
            continue
        wh, xh = w[big], x[big]
        names, column = np.unique(xh, return_inverse=True)
        places, row = np.unique(wh, return_inverse=True)
        bits = np.zeros((len(names), (len(places) + 63) // 64 * 64), np.uint8)
        bits[column, row] = 1
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for k in range(len(names) - 1):
            n = np.bitwise_count(packed[k + 1 :] & packed[k]).sum(axis=1)
            hit = np.flatnonzero(n)
            out.append(pd.DataFrame({"a": np.full(len(hit), names[k], np.int64), "b": names[k + 1 + hit].astype(np.int64), "n": n[hit].astype(np.int64)}))
        # each light item probes the list of its work's heavy items, which lies between two offsets
        first, last = np.searchsorted(wh, w[~big], "left"), np.searchsorted(wh, w[~big], "right")
        per = max(1, PAIR_MEMORY // len(names))  # no list is longer than there are heavy items
        for k in range(0, len(first), per):
            m = last[k : k + per] - first[k : k + per]
            light = np.repeat(x[~big][k : k + per], m)
            at = np.repeat(first[k : k + per] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
            out.append(_counted(np.minimum(light, xh[at]), np.maximum(light, xh[at])))
    return pd.concat(out, ignore_index=True)


def _wide_pairs(rows: DataFrame, wide: DataFrame) -> DataFrame:
    """(_a, _b, n): the pairs of the works of ``wide`` (_w, _m), part by part; ``rows`` is (_w, _x) of these works only."""
    parts = F.ceil(F.col("_m") / WIDE)
    own = rows.distinct().join(broadcast_if_small(wide), "_w").select("_w", "_x", F.pmod(F.xxhash64("_x"), parts).alias("_g"), parts.alias("_p"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_p") - 1)).alias("_o")
    sent = own.select("_w", "_x", "_g", other).select("_w", "_x", "_g", F.least("_g", "_o").alias("_lo"), F.greatest("_g", "_o").alias("_hi"))

    def run(d: pd.DataFrame) -> pd.DataFrame:
        low = d["_g"].to_numpy() == d["_lo"].iloc[0]
        x, alone = d["_x"].to_numpy(), d["_lo"].iloc[0] == d["_hi"].iloc[0]
        a, b = (x, x) if alone else (x[low], x[~low])
        same = ((a >> 1) & FIELD_MASK)[:, None] == ((b >> 1) & FIELD_MASK)[None, :]
        i, j = np.nonzero(np.triu(same) if alone else same)
        a, b = a[i] >> SHIFT, b[j] >> SHIFT
        return pd.DataFrame({"_a": np.minimum(a, b).astype(np.int32), "_b": np.maximum(a, b).astype(np.int32), "n": np.ones(len(a), np.int64)})

    return sent.groupBy("_w", "_lo", "_hi").applyInPandas(run, "_a int, _b int, n bigint")


def pair_counts(df: DataFrame, work: str = "work_id", field: str = "field_name", item: str = "item", least: int = 8, heavy: int = HEAVY, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Two tables: (_a, _b, n) of numbered pairs with _a <= _b, and the items (number, field_name, item).

    Every pair that shares at least ``least`` works is in the first table with its exact count; pairs with _a = _b hold
    the number of works of an item.
    """
    rows = df.where(f"`{work}` is not null and `{field}` is not null and `{item}` is not null").select(F.col(work).alias("_w"), F.col(field).alias("_f"), F.col(item).alias("_i"))
    counted = rows.groupBy("_f", "_i").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    bucket = F.pmod(F.xxhash64("_f", "_i"), F.lit(1024)).cast("int")
    frequent = written(counted.withColumn("_k", bucket), "items")
    top = frequent.withColumn("_r", F.row_number().over(Window.partitionBy("_f").orderBy(F.col("_n").desc(), "_i"))).where(F.col("_r") <= heavy).select("_f", "_i", F.lit(True).alias("_heavy"))
    sizes = frequent.groupBy("_k").agg(F.count("*").alias("_m"))
    offsets = sizes.withColumn("_o", F.sum("_m").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)))  # 1,024 rows
    number = F.row_number().over(Window.partitionBy("_k").orderBy("_f", "_i")) - 1 + F.coalesce("_o", F.lit(0))
    items = frequent.join(F.broadcast(top), ["_f", "_i"], "left").join(F.broadcast(offsets.select("_k", "_o")), "_k").select(number.cast("int").alias("number"), F.col("_f").alias("field_name"), F.col("_i").alias("item"), F.coalesce("_heavy", F.lit(False)).alias("_heavy"), "_n")
    items = written(items, "numbered")
    total = items.agg(F.sum("_n"), F.count("*")).first()
    blocks = max(1, int((total[0] or 0) // block_rows))
    small = row_count_at_most(items, BROADCAST_ROWS)
    few = items.select("field_name").distinct().withColumn("_c", F.row_number().over(Window.orderBy("field_name")))  # as many rows as fields
    names = items.join(broadcast_if_small(few), "field_name").select(F.col("field_name").alias("_f"), F.col("item").alias("_i"), "number", "_heavy", "_c")
    if small:
        met = rows.join(F.broadcast(names), ["_f", "_i"])
    else:
        # the heavy ones, few by definition, are broadcast; no other item is frequent enough to burden a task
        big = F.broadcast(names.where("_heavy"))
        probed = rows.join(big, ["_f", "_i"], "left")
        met = probed.where("number is not null").unionByName(probed.where("number is null").drop("number", "_heavy", "_c").join(names.where("not _heavy"), ["_f", "_i"]))
    coded = met.select("_w", (F.shiftleft(F.col("number").cast("long"), SHIFT) + F.col("_c") * 2 + F.col("_heavy").cast("int")).alias("_x"))
    works = rows.groupBy("_w").agg(F.count("*").alias("_m")).where(F.col("_m") > WIDE)
    wide = checkpointed(works)
    some = not wide.isEmpty()
    normal = coded.join(broadcast_if_small(wide.select("_w")), "_w", "left_anti") if some else coded
    placed = normal.select(F.pmod(F.xxhash64("_w"), F.lit(blocks)).cast("int").alias("_block"), "_w", "_x")
    shuffled = placed.repartition(min(blocks, PARTITIONS), "_block").sortWithinPartitions("_block")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        current = None

        def done() -> pd.DataFrame:
            d = pd.concat(kept)
            x = d["_x"].to_numpy()
            codes, item_at = np.unique(x, return_inverse=True)
            _, work_at = np.unique(d["_w"].to_numpy(), return_inverse=True)
            c = count_block(work_at, item_at, (codes >> 1) & FIELD_MASK, (codes & 1).astype(bool))
            return pd.DataFrame({"_a": codes[c["a"]] >> SHIFT, "_b": codes[c["b"]] >> SHIFT, "n": c["n"]}).astype({"_a": "int32", "_b": "int32", "n": "int64"})

        for d in it:
            for block, part in d.groupby("_block", sort=True):
                if kept and block != current:
                    yield done()
                    kept = []
                current = block
                kept.append(part)
        if kept:
            yield done()

    partial = shuffled.mapInPandas(run, "_a int, _b int, n bigint")
    if some:
        partial = partial.unionByName(_wide_pairs(coded.join(broadcast_if_small(wide.select("_w")), "_w", "left_semi"), wide))
    return partial.groupBy("_a", "_b").agg(F.sum("n").alias("n")).where(F.col("n") >= least), items.select("number", "field_name", "item")


def associated(df: DataFrame, work: str = "work_id", field: str = "field_name", item: str = "item", least: int = 8, lift: int = 20) -> DataFrame:
    """(field_name, item_a, item_b, n_ab, n_a, n_b, lift): pairs of one field, item_a < item_b by code point, that share at
    least ``least`` works and stand together at least ``lift`` times as often as by chance, n_ab * N >= lift * n_a * n_b.

    N counts the distinct works of the whole table. Defined results: null works, fields and items make no pair (but null
    items' works count in N); rows that repeat and an item twice in a work count once; an empty table gives no row.
    """
    n_works = df.agg(F.countDistinct(F.col(work))).first()[0]
    pairs, items = pair_counts(df, work, field, item, least)
    pairs = written(pairs, "pairs")
    singles = pairs.where("_a = _b")
    a = singles.select(F.col("_a"), F.col("n").alias("n_a"))
    b = singles.select(F.col("_a").alias("_b"), F.col("n").alias("n_b"))
    name = lambda side: items.select(F.col("number").alias(f"_{side}"), F.col("field_name").alias(f"_f{side}"), F.col("item").alias(f"_i{side}"))
    met = pairs.where("_a <> _b").withColumnRenamed("n", "n_ab").join(a, "_a").join(b, "_b")
    # the product of two counts may pass a long
    kept = met.where(F.col("n_ab").cast("decimal(19,0)") * F.lit(n_works).cast("decimal(19,0)") >= F.col("n_a").cast("decimal(19,0)") * F.col("n_b").cast("decimal(19,0)") * lift)
    named = kept.join(name("a"), "_a").join(name("b"), "_b")
    swap = F.col("_ia") > F.col("_ib")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return named.select(
        F.col("_fa").alias("field_name"), either("_ia", "_ib").alias("item_a"), either("_ib", "_ia").alias("item_b"), "n_ab", either("n_a", "n_b").alias("n_a"), either("n_b", "n_a").alias("n_b"),
        (F.col("n_ab").cast("double") * n_works / F.col("n_a") / F.col("n_b")).alias("lift"),
    )
