"""Filling containers of fixed capacity with documents (problem 8): pattern packing by non-negative least squares.

Only the histogram of lengths reaches the driver: one number for each length up to the capacity. There,

1. patterns of one to three documents that fill a container are enumerated on lengths rounded up to a grid,
2. non-negative least squares fits how often each pattern is used to the histogram, counts are rounded down
   and cut to what the histogram holds,
3. what is left is packed into the gaps of those containers, largest first and tightest gap first, and then into
   new containers, many alike containers in one step.

The outcome is a list of segments (length, first rank, number of ranks, per container, first container). Its
size depends on the capacity, not on the number of documents. Each document then finds its
container from its rank among the documents of its length, which is counted in hash buckets so that a length
that a third of the documents share is not ranked by one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.llm.tokens import token_count
from quillmill.plans import checkpointed

#: Cells of the grid of lengths on which patterns are enumerated.
GRID = 64

#: Documents of one length that one task ranks, about; the most frequent length decides the number of buckets.
RANK_ROWS = 100_000


def patterns_of(grid: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of one to three parts of 1..grid with sum ``grid``."""
    out: list[tuple[int, ...]] = [(grid,)]
    for a in range(1, grid):
        if a >= grid - a:
            out.append((a, grid - a))
        for b in range(1, grid - a):
            c = grid - a - b
            if a >= b >= c:
                out.append((a, b, c))
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Minimises |a x - b| over x >= 0 by coordinate descent on the normal equations."""
    gram, target = a.T @ a, a.T @ b
    x, grad = np.zeros(a.shape[1]), -target.astype(float)
    diag = np.maximum(np.diag(gram), 1e-12)
    for _ in range(rounds):
        gain = np.where(x > 0, np.abs(grad), np.maximum(-grad, 0)) / np.sqrt(diag)
        k = int(np.argmax(gain))
        if gain[k] < 1e-6 * (1 + np.abs(b).max()):
            break
        new = max(0.0, x[k] - grad[k] / diag[k])
        grad += gram[:, k] * (new - x[k])
        x[k] = new
    return x


@dataclass
class Plan:
    """Segments of ranks and the number of containers."""

    capacity: int
    containers: int = 0
    segments: list[tuple[int, int, int, int, int]] = field(default_factory=list)

    def put(self, length: int, rank: int, n: int, each: int, base: int) -> None:
        self.segments.append((length, rank, n, each, base))


def plan_containers(histogram: dict[int, int], capacity: int, grid: int = GRID) -> Plan:
    """The plan for a histogram of lengths 1..capacity; see the module's text."""
    plan = Plan(capacity)
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    used = np.zeros(capacity + 1, np.int64)
    grid = max(1, min(grid, capacity))
    cell = np.ceil(np.arange(capacity + 1) * grid / capacity).astype(int)
    totals = np.bincount(cell, weights=left, minlength=grid + 1)[1:]
    kinds = patterns_of(grid)
    matrix = np.zeros((grid, len(kinds)))
    for k, parts in enumerate(kinds):
        for p in parts:
            matrix[p - 1, k] += 1
    # long documents first: their rows weigh more, as short ones find a gap anywhere
    weight = np.sqrt(np.arange(1, grid + 1) / grid)
    counts = nnls(matrix * weight[:, None], totals * weight)
    free: list[tuple[int, int, int]] = []  # gap, number of containers, first container; kept sorted

    def take(want: int, lengths: list[int]) -> tuple[int, int]:
        """The longest length with any left, and how many of ``want`` it can give."""
        for x in lengths:
            if left[x]:
                return x, min(want, int(left[x]))
        return 0, 0

    def use(length: int, n: int, each: int, base: int) -> None:
        plan.put(length, int(used[length]), n, each, base)
        used[length] += n
        left[length] -= n

    lengths_in = [sorted(np.flatnonzero(cell == c).tolist(), reverse=True) for c in range(grid + 1)]
    for k in sorted(range(len(kinds)), key=lambda k: kinds[k], reverse=True):
        whole = int(counts[k] + 1e-9)
        while whole > 0:
            # one length for each part; as many containers as all of them can supply
            chosen, supply = [], whole
            for p in kinds[k]:
                x, n = take(whole, lengths_in[p])
                chosen.append(x)
                supply = min(supply, n)
            if not all(chosen):
                break
            for x in set(chosen):
                supply = min(supply, int(left[x]) // chosen.count(x))
            if supply <= 0:
                break
            for x in chosen:
                use(x, supply, 1, plan.containers)
            if gap := capacity - sum(chosen):
                insort(free, (gap, supply, plan.containers))
            plan.containers += supply
            whole -= supply
    for length in range(capacity, 0, -1):
        while left[length]:
            at = bisect_left(free, (length, 0, 0))
            if at == len(free):
                each = capacity // length
                n = int(left[length])
                new = n // each or 1
                each = min(each, n)
                base = plan.containers
                plan.containers += new
                use(length, new * each, each, base)
                if gap := capacity - each * length:
                    insort(free, (gap, new, base))
                continue
            gap, n, base = free.pop(at)
            each = min(gap // length, int(left[length]))
            filled = min(n, int(left[length]) // each)
            use(length, filled * each, each, base)
            if rest := gap - each * length:
                insort(free, (rest, filled, base))
            if filled < n:
                insort(free, (gap, n - filled, base + filled))
    return plan


def located(plan: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """Segments by length, sorted by rank, as arrays."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    for length, rank, _, each, base in plan.segments:
        by.setdefault(length, []).append((rank, each, base))
    return {k: tuple(np.array(x, np.int64) for x in zip(*sorted(v), strict=True)) for k, v in by.items()}


def pack(sized: DataFrame, key: str, size: str, capacity: int, grid: int = GRID) -> DataFrame:
    """Containers for the rows of ``sized``: (key, piece_no, start, n_tokens, container_id).

    A row longer than ``capacity`` is cut into full containers and a rest; no other row is split. Rows of size 0
    or null take no space: they come out once with n_tokens 0 and a null container_id. Repeated keys are
    packed each. ``sized`` is read twice and should be a written or checkpointed table; an empty table gives no rows.
    """
    spark = sized.sparkSession
    n = F.coalesce(F.col(size), F.lit(0)).cast("int")
    rows = sized.select(F.col(key).alias("_key"), n.alias("_n"))
    whole = rows.select("_key", "_n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("_n") - 1) / capacity).cast("int")))).alias("_piece"))
    pieces = whole.select("_key", "_piece", (F.col("_piece") * capacity).alias("_start"), F.least(F.lit(capacity), F.col("_n") - F.col("_piece") * capacity).alias("_size"))
    counted = {r["_size"]: r["n"] for r in pieces.where("_size > 0").groupBy("_size").agg(F.count("*").alias("n")).collect()}
    plan = plan_containers(counted, capacity, grid)
    where = spark.sparkContext.broadcast(located(plan))

    buckets = 8 + max(counted.values(), default=0) // RANK_ROWS
    bucket = F.pmod(F.xxhash64("_key", "_piece"), F.lit(buckets)).cast("int")
    sorted_pieces = pieces.where("_size > 0").withColumn("_bucket", bucket)
    offsets = (
        sorted_pieces.groupBy("_size", "_bucket").agg(F.count("*").alias("_m"))
        .withColumn("_before", F.sum("_m").over(Window.partitionBy("_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("_size", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    )  # at most capacity x buckets rows
    ranked = sorted_pieces.withColumn("_in", F.row_number().over(Window.partitionBy("_size", "_bucket").orderBy("_key", "_piece")) - 1)
    ranked = ranked.join(offsets, ["_size", "_bucket"]).select("_key", "_piece", "_start", "_size", (F.col("_in") + F.col("_before")).alias("_rank"))

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segments = where.value
        for d in it:
            out = np.zeros(len(d), np.int64)
            sizes, ranks = d["_size"].to_numpy(), d["_rank"].to_numpy()
            order = np.argsort(sizes, kind="stable")
            cuts = np.flatnonzero(np.diff(sizes[order])) + 1
            for part in np.split(order, cuts) if len(d) else ():
                first, each, base = segments[int(sizes[part[0]])]
                at = np.searchsorted(first, ranks[part], side="right") - 1
                out[part] = base[at] + (ranks[part] - first[at]) // each[at]
            yield pd.DataFrame({"_key": d["_key"], "piece_no": d["_piece"], "start_token": d["_start"], "n_tokens": d["_size"], "container_id": out})

    kind = sized.schema[key].dataType.simpleString()
    placed = ranked.mapInPandas(assign, f"_key {kind}, piece_no int, start_token int, n_tokens int, container_id bigint")
    nothing = pieces.where("_size <= 0").select("_key", F.lit(0).alias("piece_no"), F.lit(0).alias("start_token"), F.lit(0).alias("n_tokens"), F.lit(None).cast("bigint").alias("container_id"))
    return placed.unionByName(nothing).withColumnRenamed("_key", key)


def pack_texts(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = 2048) -> DataFrame:
    """The texts of ``df`` in containers of ``capacity`` tokens; see :func:`pack`.

    Texts are encoded once; the lengths, two numbers a row, are checkpointed before they are counted and ranked.
    """
    sized = df.select(F.col(key).alias(key), token_count(df.sparkSession, F.col(text), vocabulary).alias("_n_tokens"))
    return pack(checkpointed(sized), key, "_n_tokens", capacity)


def container_fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, and the share of their space that is unused."""
    used = packed.where("container_id is not null")
    return used.agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens")).withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6))
