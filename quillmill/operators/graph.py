"""Graph algorithms on edge tables: ranking, centrality, components, communities, paths.

Iterations are joins and aggregations; lineage is cut by reliable checkpoints. Measures that need a search from
every node (betweenness, closeness) take the graph, already pruned by weight, as a broadcast of checked size and spread the
sources over the tasks.
"""

from __future__ import annotations

import contextlib
import fcntl
import heapq
import os
import shutil
import tempfile
import uuid
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.plans import broadcast_if_small, checkpointed, dropped, row_count_at_most, written

#: Edges of a graph that every task may hold.
LOCAL_EDGES = 2_000_000

#: Cells of a matrix of sources by nodes that a task holds, and nodes whose arcs stand in a matrix at once.
CELLS, ROWS = 2_000_000, 256

#: Nodes times arcs of a component that one task searches; a larger one is searched by several, each from its share of the nodes.
SEARCHED = 2_000_000_000

#: Edges of the largest component that a task holds; the arcs of a larger one are read from a file. Arcs that are followed at once there.
HELD, PIECE = 2_000_000, 8_000_000

#: Arcs of the longest chain that is followed; beyond it there is an error, never a part of a result.
LONGEST_CHAIN = 10_000

#: Iterations between two cuts of the lineage.
CUT_EVERY = 5


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions out of undirected (a, b, w)."""
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionAll(edges.select("b", "a", "w"))


def degree(edges: DataFrame) -> DataFrame:
    """(item, degree, strength, centrality) of undirected edges; centrality is the degree over n - 1."""
    counted = both_ways(edges).groupBy(F.col("src").alias("item")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))
    n = counted.agg(F.count("*").alias("_n"))
    return counted.crossJoin(F.broadcast(n)).select("item", "degree", "strength", F.round(F.try_divide(F.col("degree"), F.col("_n") - 1), 6).alias("centrality"))  # one row


def pagerank(links: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(item, rank) after a fixed number of rounds; ``links`` is (src, dst), sinks spread their rank evenly.

    Links lie by their source with its degree, nodes by their name, so a round moves only ranks; each is cut, for the next reads it twice.
    """
    pairs = checkpointed(links.select("src", "dst").distinct())
    degrees = pairs.groupBy("src").agg(F.count("*").alias("_d"))
    out = checkpointed(pairs.join(degrees, "src").repartition("src"))
    dropped(pairs)
    nodes = checkpointed(out.select(F.col("src").alias("item"), F.lit(False).alias("_sink")).unionAll(out.select("dst", F.lit(True))).groupBy("item").agg(F.min("_sink").alias("_sink")))
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(rounds if n else 0):
        loose = ranks.where("_sink").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("_l"))
        sent = out.join(ranks.select(F.col("item").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("item")).agg(F.sum(F.col("rank") / F.col("_d")).alias("_s"))
        new = nodes.join(sent, "item", "left").crossJoin(F.broadcast(loose)).select("item", "_sink", ((1 - damping) / n + damping * (F.coalesce("_s", F.lit(0.0)) + F.col("_l") / n)).alias("rank"))  # one row
        new, old = checkpointed(new), ranks
        if k:
            dropped(old)
        ranks = new
    return ranks.select("item", "rank")


def power_iteration(edges: DataFrame, rounds: int = 30, katz: float | None = None) -> DataFrame:
    """(item, score): eigenvector centrality, or Katz centrality for a given alpha, of undirected edges; length 1."""
    links = checkpointed(both_ways(edges))
    scores = links.select(F.col("src").alias("item")).distinct().withColumn("score", F.lit(1.0))
    names = scores.select("item")
    for k in range(rounds):
        moved = links.join(scores.select(F.col("item").alias("src"), "score"), "src").groupBy(F.col("dst").alias("item")).agg(F.sum(F.col("score") * F.col("w")).alias("_s"))
        new = names.join(moved, "item", "left").select("item", F.coalesce("_s", F.lit(0.0)).alias("_s"))
        new = new.select("item", (katz * F.col("_s") + 1).alias("score")) if katz is not None else new.select("item", F.col("_s").alias("score"))
        if katz is None:
            length = new.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("_l"))
            new = new.crossJoin(F.broadcast(length)).select("item", (F.col("score") / F.col("_l")).alias("score"))  # one row
        scores = checkpointed(new) if k % CUT_EVERY == CUT_EVERY - 1 else new
    length = scores.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("_l"))
    return scores.crossJoin(F.broadcast(length)).select("item", F.round(F.col("score") / F.col("_l"), 6).alias("score"))


def salsa(links: DataFrame, rounds: int = 150, tolerance: float = 1e-6) -> DataFrame:
    """(item, hub, authority) of (src, dst): hubs over out-degrees, authorities over in-degrees, each summing to 1.

    Ends when both change by less than ``tolerance`` in all, or after ``rounds``. The hub step uses the authorities before they
    are scaled (the literal rule).
    """
    links = links.select("src", "dst").distinct()
    out = links.groupBy("src").agg(F.count("*").alias("_o"))
    into = links.groupBy("dst").agg(F.count("*").alias("_i"))
    both = checkpointed(links.join(out, "src").join(into, "dst"))
    nodes = checkpointed(both.select(F.col("src").alias("item")).union(both.select("dst")).distinct())
    n = max(nodes.count(), 1)
    scores = nodes.select("item", F.lit(1.0 / n).alias("hub"), F.lit(1.0 / n).alias("authority"))
    last = None
    for _ in range(rounds):
        auth = both.join(scores.select(F.col("item").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("item")).agg(F.sum(F.col("hub") / F.col("_o")).alias("_a"))
        hubs = both.join(auth.select(F.col("item").alias("dst"), "_a"), "dst").groupBy(F.col("src").alias("item")).agg(F.sum(F.col("_a") / F.col("_i")).alias("_h"))
        raw = checkpointed(scores.join(hubs, "item", "left").join(auth, "item", "left").fillna(0.0, ["_h", "_a"]))
        if last is not None:
            dropped(last)
        last = raw
        h, a = raw.agg(F.sum("_h"), F.sum("_a")).first()
        new = raw.withColumns({"_h": F.col("_h") / (h or 1.0), "_a": F.col("_a") / (a or 1.0)})
        change = new.agg(F.sum(F.abs(F.col("_h") - F.col("hub"))), F.sum(F.abs(F.col("_a") - F.col("authority")))).first()
        scores = new.select("item", F.col("_h").alias("hub"), F.col("_a").alias("authority"))
        if max(x or 0.0 for x in change) < tolerance:
            break
    return scores


def decade_tops(scores: DataFrame, years: DataFrame, top: int = 5) -> DataFrame:
    """(decade, kind, place, item, score): the best hubs and authorities of each decade; ``years``: (item, year), all nodes; ties to smaller items."""
    rows = years.where("year is not null and year <> -1").join(scores, "item", "left").fillna(0.0, ["hub", "authority"])
    long = rows.select((F.floor(F.col("year") / 10) * 10).cast("int").alias("decade"), "item", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("score")) for k in ("hub", "authority")))))
    order = Window.partitionBy("decade", "kind").orderBy(F.col("score").desc(), "item")
    return long.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("decade", "kind", "place", "item", "score")


def components(edges: DataFrame) -> DataFrame:
    """(item, component): the smallest item reachable over undirected (a, b).

    Large and small stars: every round hangs neighbours on the smallest, so chains shrink by half and more; the rounds end
    when the links stay as they are, which their number and two sums of hashes tell.
    """

    def mark(links: DataFrame) -> tuple:
        h = lambda *salt: F.sum(F.xxhash64("u", "v", *salt).cast("decimal(38,0)"))
        return tuple(links.agg(F.count("*"), h(), h(F.lit("second"))).first())

    links = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = mark(links)
    while before[0]:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = checkpointed(small)
        dropped(links)
        links, last, before = new, before, mark(new)
        if last == before:
            break
    items = edges.select(F.col("a").alias("item")).union(edges.select("b")).distinct()
    return items.join(links.groupBy(F.col("u").alias("item")).agg(F.min("v").alias("_c")), "item", "left").select("item", F.coalesce("_c", "item").alias("component"))


def constraint(edges: DataFrame) -> DataFrame:
    """(item, constraint): structural holes, the sum over neighbours of (p_ij + sum_q p_iq p_qj) squared."""
    links = both_ways(edges)
    total = links.groupBy("src").agg(F.sum("w").alias("_t"))
    p = links.join(total, "src").select("src", "dst", (F.col("w") / F.col("_t")).alias("p"))
    two = p.select(F.col("src").alias("i"), F.col("dst").alias("q"), F.col("p").alias("p1")).join(p.select(F.col("src").alias("q"), F.col("dst").alias("j"), F.col("p").alias("p2")), "q").where("i <> j").groupBy("i", "j").agg(F.sum(F.col("p1") * F.col("p2")).alias("_s"))
    full = p.select(F.col("src").alias("i"), F.col("dst").alias("j"), "p").join(two, ["i", "j"], "left")
    v = F.col("p") + F.coalesce("_s", F.lit(0.0))
    return full.groupBy(F.col("i").alias("item")).agg(F.round(F.sum(v * v), 6).alias("constraint"))


def _adjacency(edges: DataFrame, limit: int) -> dict:
    rows = edges.select("a", "b").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} edges: prune the graph by weight first")
    adj: dict = defaultdict(list)
    for r in rows:
        if r["a"] != r["b"]:
            adj[r["a"]].append(r["b"])
            adj[r["b"]].append(r["a"])
    return dict(adj)


def _from_each(edges: DataFrame, limit: int, search, columns: str) -> DataFrame:
    """Runs ``search(adjacency, source)``, which yields rows, from every node of a pruned graph."""
    spark = edges.sparkSession
    adj = spark.sparkContext.broadcast(_adjacency(edges, limit))
    nodes = edges.select(F.col("a").alias("item")).union(edges.select("b")).distinct()
    names = [c.split()[0] for c in columns.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in it:
            yield pd.DataFrame([row for s in d["item"] for row in search(adj.value, s)], columns=names)

    return nodes.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, columns)


def _arrays(edges: DataFrame, limit: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Names of the nodes, then offsets, neighbours by number and weights of undirected edges in both directions."""
    rows = edges.select("a", "b", F.col("w").cast("double").alias("w")).limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        raise ValueError(f"more than {limit} edges: prune the graph by weight first")
    coded = pa.chunked_array([*rows["a"].chunks, *rows["b"].chunks], rows.schema.field("a").type).combine_chunks().dictionary_encode()
    a, b = np.split(coded.indices.to_numpy().astype(np.int64), 2)
    other = a != b
    src, dst, w = np.concatenate([a[other], b[other]]), np.concatenate([b[other], a[other]]), np.tile(rows["w"].to_numpy()[other], 2)
    names, order = coded.dictionary.to_pylist(), np.argsort(src, kind="stable")
    return names, np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(names)))]), dst[order], w[order]


def _arcs_of(starts: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many arcs each of ``nodes`` has, and the places of them all."""
    many = starts[nodes + 1] - starts[nodes]
    return many, np.repeat(starts[nodes] - np.cumsum(many) + many, many) + np.arange(many.sum())


def _dependencies(starts: np.ndarray, ends: np.ndarray, s: int) -> np.ndarray:
    """What the shortest paths from ``s`` add to the betweenness of every other node."""
    n = len(starts) - 1
    seen, sigma, delta = np.zeros(n, bool), np.zeros(n), np.zeros(n)
    seen[s], sigma[s] = True, 1.0
    front, levels = np.array([s]), []
    while len(front):
        many, at = _arcs_of(starts, front)
        new = ~seen[ends[at]]
        v, w = np.repeat(front, many)[new], ends[at][new]
        np.add.at(sigma, w, sigma[v])
        seen[w] = True
        front = np.unique(w)
        levels.append((v, w))
    for v, w in reversed(levels):
        np.add.at(delta, v, sigma[v] / sigma[w] * (1 + delta[w]))
    delta[s] = 0.0
    return delta


def _loads(starts: np.ndarray, ends: np.ndarray, s: int) -> np.ndarray:
    """The load of every other node if every node sends one unit to ``s`` and each hands it on evenly to the nodes that are nearer."""
    n = len(starts) - 1
    seen, load = np.zeros(n, bool), np.zeros(n)
    seen[s] = True
    front, levels = np.array([s]), []
    while len(front):
        many, at = _arcs_of(starts, front)
        new = ~seen[ends[at]]
        v, w = np.repeat(front, many)[new], ends[at][new]
        seen[w] = True
        front = np.unique(w)
        levels.append((v, w))
    for v, w in reversed(levels):
        np.add.at(load, v, (1 + load[w]) / np.bincount(w, minlength=n)[w])
    load[s] = 0.0
    return load


def _summed_over_sources(edges: DataFrame, limit: int, search, name: str, digits: int | None) -> DataFrame:
    """(item, name): the sum over all sources of what ``search`` gives each node, scaled to the number of pairs of other nodes."""
    spark = edges.sparkSession
    names, *arrays = _arrays(edges, limit)
    n, kind = len(names), edges.schema["a"].dataType.simpleString()
    graph = spark.sparkContext.broadcast((names, *arrays))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, starts, ends, _ = graph.value
        total = np.zeros(len(names))
        for d in it:
            for s in d["id"]:
                total += search(starts, ends, s)
        yield pd.DataFrame({"item": names, "part": total})

    parts = spark.range(0, n, 1, spark.sparkContext.defaultParallelism).mapInPandas(run, f"item {kind}, part double").groupBy("item").agg(F.sum("part").alias("_s"))
    value = F.col("_s") / max((n - 1) * (n - 2), 1)
    return parts.select("item", (value if digits is None else F.round(value, digits)).alias(name))


def _stars(edges: DataFrame) -> DataFrame:
    """(a, b): from each item of a part of the edges to one item of its component there, few rows where there are many edges."""
    kind = edges.schema["a"].dataType.simpleString()

    def hung(d: pd.DataFrame) -> pd.DataFrame:
        codes, items = pd.factorize(pd.concat([d["a"], d["b"]], ignore_index=True))
        a, b = np.split(codes, 2)
        root = np.arange(len(items))
        while (root[a] != root[b]).any():
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (root != root[root]).any():
                root = root[root]
        return pd.DataFrame({"a": items, "b": np.asarray(items)[root]})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for d in it:
            held.append(d)
            rows += len(d)
            if rows > CELLS:
                held = [hung(pd.concat(held, ignore_index=True))]
                rows = 0
        if held:
            yield hung(pd.concat(held, ignore_index=True))

    return edges.select("a", "b").mapInPandas(run, f"a {kind}, b {kind}")


def _by_component(edges: DataFrame, search, column: str, weighted: bool) -> DataFrame:
    """(item, column): the sums of what ``search(starts, ends, weights, sources)``, which gives (nodes, values), gives each node.

    Each component is searched by itself, in one task or more, so neither the driver nor a task holds the whole graph.
    """
    places = Window.partitionBy("component").orderBy("item")  # items of one component
    nodes = components(written(_stars(edges), "stars")).withColumn("k", (F.row_number().over(places) - 1).cast("int"))
    nodes = written(nodes, "nodes")
    table = broadcast_if_small(nodes, 50_000)
    links = edges.where("a <> b").join(table.toDF("a", "component", "_i"), "a").join(table.select(F.col("item").alias("b"), F.col("k").alias("_j")), "b")
    # rows of a node's neighbours, as a component that several tasks search is sent to each of them; a long list is cut
    lists = links.groupBy("component", "_i", F.floor(F.col("_j") / 4096)).agg(F.collect_list(F.struct("_j", F.col("w").cast("double").alias("w")) if weighted else F.struct("_j")).alias("_l"))
    links = written(lists.select("component", "_i", F.col("_l._j").alias("_j"), *([F.col("_l.w").alias("w")] if weighted else [])), "links")
    most = edges.sparkSession.sparkContext.defaultParallelism
    weights = [F.min(F.array_min("w")).alias("_lo"), F.max(F.array_max("w")).alias("_hi"), F.min(F.forall("w", lambda x: x == F.floor(x))).alias("_whole")] if weighted else [F.lit(1.0).alias("_lo"), F.lit(1.0).alias("_hi"), F.lit(True).alias("_whole")]
    sizes = links.groupBy("component").agg(F.sum(F.size("_j")).alias("_m"), *weights).join(nodes.groupBy("component").agg(F.count("*").cast("int").alias("_n")), "component")
    sizes = written(sizes, "sizes").withColumn("_parts", F.least(F.ceil(2.0 * F.col("_m") * F.col("_n") / SEARCHED), F.lit(most)).cast("int"))

    def run(d: pd.DataFrame) -> pd.DataFrame:
        n, parts, part, component = int(d["_n"].iat[0]), int(d["_parts"].iat[0]), int(d["_part"].iat[0]), d["component"].iat[0]
        a, b = np.repeat(d["_i"].to_numpy(np.int32), d["_j"].map(len)), np.concatenate(d["_j"].to_list()).astype(np.int32)
        w = np.concatenate(d["w"].to_list()) if weighted else None
        src, ends = np.concatenate([a, b]), np.concatenate([b, a])
        del d, a, b
        order = np.argsort(src, kind="stable")
        ends, w = ends[order], np.tile(w, 2)[order] if weighted else None
        starts = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
        del src, order
        k, x = search(starts, ends, w, np.arange(part, n, parts))
        return pd.DataFrame({"component": component, "k": k.astype(np.int32), "x": x})

    held = sizes.where(F.col("_m") <= HELD).select("component", "_n", "_parts")
    each = links.join(broadcast_if_small(held, 50_000), "component").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    kind = nodes.schema["component"].dataType.simpleString()
    found = each.groupBy("component", "_part").applyInPandas(run, f"component {kind}, k int, x double")
    if large := sizes.where(F.col("_m") > HELD).collect():  # one row for millions of edges
        found = found.unionByName(_from_files(links, large, search, weighted, most))
    return written(nodes.join(found.groupBy("component", "k").agg(F.sum("x").alias(column)), ["component", "k"], "left").select("item", column), "searched")


def _from_files(links: DataFrame, large: list, search, weighted: bool, parts: int) -> DataFrame:
    """(component, k, x): what ``search`` gives for the components of ``large``, rows with their sizes and weights.

    Each task searches from its share of the nodes. It reads all arcs, of which the tasks of a machine share one file, and holds
    only those that it follows.
    """
    spark, name = links.sparkSession, f"quillmill-arcs-{uuid.uuid4().hex}"
    table = spark.createDataFrame([(r["component"], c) for c, r in enumerate(large)], f"component {links.schema['component'].dataType.simpleString()}, _c int")
    sizes = [(r["_n"], r["_m"], _weight_kind(r["_lo"], r["_hi"], r["_whole"])) for r in large]
    arcs = links.join(F.broadcast(table), "component").select("_c", "_i", "_j", *(["w"] if weighted else []))  # a row for millions of edges
    # each part reads the table by itself, so that the arcs are neither shuffled nor stored for each of them; the last one is empty
    # and cut into several, without which the union would put the others, of one task each, into one
    wanted = [arcs.coalesce(1).withColumn("_part", F.lit(part)) for part in range(parts)]
    each = reduce(DataFrame.unionAll, [*wanted, arcs.where("_i < 0").withColumn("_part", F.lit(parts))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (first := next(batches, None)) is None:
            return
        part = first["_part"][0].as_py()
        with _filed(name, chain([first], batches), sizes) as graphs:
            for c, (starts, ends, w) in enumerate(graphs):
                k, x = search(starts, ends, w, np.arange(part, len(starts) - 1, parts))
                for at in range(0, len(k), ROWS * ROWS):
                    own = slice(at, at + ROWS * ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[own]), c, np.int32)), pa.array(k[own].astype(np.int32)), pa.array(x[own])], ["_c", "k", "x"])

    return each.mapInArrow(run, "_c int, k int, x double").join(F.broadcast(table), "_c").select("component", "k", "x")  # a row for millions of edges


def _weight_kind(low: float, high: float, whole: bool) -> str:
    """The smallest type that holds the weights; none where all are 1."""
    if low == high == 1:
        return ""
    return next((k for k, most in (("u1", 2**8), ("u2", 2**16), ("u4", 2**32)) if whole and low >= 0 and high < most), "f8")


@contextlib.contextmanager
def _filed(name: str, batches: Iterator[pa.RecordBatch], sizes: list[tuple[int, int, str]]) -> Iterator[list[tuple]]:
    """For each component its offsets, ends and weights, in files of this machine that the first task writes and the last one deletes."""
    folder = os.path.join(tempfile.gettempdir(), name)
    with open(f"{folder}.lock", "a") as lock, open(f"{folder}.used", "a") as used:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.isdir(folder):
            made = tempfile.mkdtemp(prefix=f"{name}-")
            try:
                _file(made, batches, sizes)
                os.rename(made, folder)
            except BaseException:
                shutil.rmtree(made, ignore_errors=True)
                raise
        fcntl.flock(used, fcntl.LOCK_SH)
        fcntl.flock(lock, fcntl.LOCK_UN)
        for _ in batches:  # what another task has written
            pass
        try:
            of = lambda c, what, kind: np.asarray(np.memmap(f"{folder}/{c}-{what}", kind, "r"))
            yield [(np.load(f"{folder}/{c}-starts.npy"), of(c, "ends", _end_kind(n)), of(c, "w", kind) if kind else None) for c, (n, _, kind) in enumerate(sizes)]
        finally:
            fcntl.flock(lock, fcntl.LOCK_EX)
            with contextlib.suppress(BlockingIOError):
                fcntl.flock(used, fcntl.LOCK_EX | fcntl.LOCK_NB)
                shutil.rmtree(folder, ignore_errors=True)


def _end_kind(n: int) -> str:
    return "u2" if n <= 2**16 else "u4"


def _file(folder: str, batches: Iterator[pa.RecordBatch], sizes: list[tuple[int, int, str]]) -> None:
    """Writes the arcs of each component in both directions, by their first node and, within it, their second."""
    degrees = [np.zeros(n, np.int64) for n, _, _ in sizes]
    parts = ("a", "b", "v")
    with contextlib.ExitStack() as open_files:
        raw = [[open_files.enter_context(open(f"{folder}/{c}-{x}", "wb")) for x in parts] for c in range(len(sizes))]
        for batch in batches:
            of = batch["_c"].to_numpy()
            for c in np.unique(of):
                d, (n, _, kind) = (batch if (of == c).all() else batch.filter(pa.array(of == c))), sizes[c]
                many = d["_j"].value_lengths().to_numpy()
                a, b = np.repeat(d["_i"].to_numpy(), many), d["_j"].flatten().to_numpy()
                degrees[c] += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
                for f, x, to in zip(raw[c], (a, b, d["w"].flatten().to_numpy() if kind else None), (_end_kind(n), _end_kind(n), kind), strict=True):
                    if x is not None:
                        f.write(memoryview(x.astype(to)))
    for c, (n, m, kind) in enumerate(sizes):
        starts = np.concatenate([[0], np.cumsum(degrees[c])])
        free = starts[:-1].copy()
        a, b = (np.asarray(np.memmap(f"{folder}/{c}-{x}", _end_kind(n), "r")) for x in "ab")
        v = np.asarray(np.memmap(f"{folder}/{c}-v", kind, "r")) if kind else None
        if len(a) != m:
            raise RuntimeError(f"{len(a)} of {m} edges came")
        ends, w = (np.asarray(np.memmap(f"{folder}/{c}-{x}", to, "w+", shape=2 * m)) if to else None for x, to in (("ends", _end_kind(n)), ("w", kind)))
        for k in range(0, m, PIECE // 8):
            own = slice(k, k + PIECE // 8)
            src, dst = np.concatenate([a[own], b[own]]), np.concatenate([b[own], a[own]])
            order = np.argsort(src, kind="stable")
            src, many = src[order], np.bincount(src, minlength=n)
            at = free[src] + np.arange(len(src)) - (np.cumsum(many) - many)[src]
            ends[at] = dst[order]
            if kind:
                w[at] = np.tile(v[own], 2)[order]
            free += many
        for k in range(n):
            own = slice(starts[k], starts[k + 1])
            if kind:
                order = np.argsort(ends[own], kind="stable")
                w[own] = w[own][order]
                ends[own] = ends[own][order]
            else:
                ends[own].sort()
        np.save(f"{folder}/{c}-starts.npy", starts)
        for x in parts:
            os.remove(f"{folder}/{c}-{x}")


def _pieces(starts: np.ndarray, nodes: np.ndarray) -> list[np.ndarray]:
    """``nodes`` in parts of about ``PIECE`` arcs."""
    arcs = np.cumsum(starts[nodes + 1] - starts[nodes])
    return np.split(nodes, np.flatnonzero(np.diff(arcs // PIECE)) + 1)


def _taken(xs: np.ndarray, starts: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """What stands in ``xs`` for the arcs of ``nodes``."""
    if starts[nodes + 1].sum() - starts[nodes].sum() > 100 * len(nodes):
        return np.concatenate([xs[a:b] for a, b in zip(starts[nodes].tolist(), starts[nodes + 1].tolist(), strict=True)])
    return xs[_arcs_of(starts, nodes)[1]]


class _Near:
    """Sums over the arcs of nodes, each of which has some; the arcs last followed stay, if they are few, as they are often followed back next."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, w: np.ndarray | None = None) -> None:
        self.starts, self.ends, self.w, self.n = starts, ends, w, len(starts) - 1
        self.many = np.diff(starts)
        self.last: tuple[np.ndarray | None, np.ndarray | None] = (None, None)

    def _ends(self, nodes: np.ndarray) -> np.ndarray:
        if self.last[0] is not nodes:
            self.last = (None, None)
            self.last = (nodes, _taken(self.ends, self.starts, nodes).astype(np.intp))
        return self.last[1]

    def _parts(self, nodes: np.ndarray) -> list[np.ndarray]:
        return [nodes] if self.many[nodes].sum() <= PIECE else _pieces(self.starts, nodes)

    def gathered(self, x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """For each of ``nodes`` the sum of ``x`` over its neighbours, times the weights if there are any."""
        out = []
        for own in self._parts(nodes):
            values = x[self._ends(own)]
            if self.w is not None:
                values *= _taken(self.w, self.starts, own)
            out.append(np.add.reduceat(values, np.cumsum(self.many[own]) - self.many[own]))
        return np.concatenate(out)

    def scattered(self, x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """What each node has if every one of ``nodes`` sends its ``x`` to all neighbours."""
        out = np.zeros(self.n)
        for own in self._parts(nodes):
            same = (x[own] == x[own[0]]).all()
            out += np.bincount(self._ends(own), None if same else np.repeat(x[own], self.many[own]), self.n) * (x[own[0]] if same else 1.0)
        return out

    def dependencies(self, s: int) -> np.ndarray:
        """As :func:`_dependencies`, of a connected graph; between two levels the arcs of that side are followed which has fewer."""
        seen, sigma, delta = np.zeros(self.n, bool), np.zeros(self.n), np.zeros(self.n)
        seen[s], sigma[s] = True, 1.0
        levels, rest = [np.array([s])], np.flatnonzero(~seen)
        while len(rest):
            near = levels[-1]
            if self.many[near].sum() <= self.many[rest].sum():
                got = self.scattered(sigma, near)[rest]
            else:
                before = np.zeros(self.n)
                before[near] = sigma[near]
                got = self.gathered(before, rest)
            far, rest = rest[got > 0], rest[got == 0]
            sigma[far] = got[got > 0]
            levels.append(far)
        for near, far in zip(levels[-2:0:-1], levels[:1:-1], strict=True):
            share = np.zeros(self.n)
            share[far] = (1 + delta[far]) / sigma[far]
            delta[near] = sigma[near] * (self.gathered(share, near) if self.many[near].sum() <= self.many[far].sum() else self.scattered(share, far)[near])
        return delta


def _through(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, w: np.ndarray | None) -> np.ndarray:
    """The product of ``x`` and the matrix of the arcs, of which ``ROWS`` rows are made at a time."""
    out = np.zeros_like(x)
    for at in range(0, x.shape[1], ROWS):
        rows = np.arange(at, min(at + ROWS, x.shape[1]))
        if x[:, rows].any():
            out += x[:, rows] @ _matrix(starts, ends, w, rows)
    return out


def _matrix(starts: np.ndarray, ends: np.ndarray, w: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    many, at = _arcs_of(starts, rows)
    out = np.zeros((len(rows), len(starts) - 1))
    out[np.repeat(np.arange(len(rows)), many), ends[at]] = 1.0 if w is None else w[at]
    return out


def _dependencies_of_all(starts: np.ndarray, ends: np.ndarray, w: None, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the shortest paths from ``sources`` add to each node of a connected graph; dense graphs by products of matrices.

    The farthest level is known when no node is left, so its arcs are not followed again.
    """
    n = len(starts) - 1
    total = np.zeros(n)
    if n * n > 8 * len(ends) or n > CELLS // 50:  # products of few rows with many are not worth it
        near = _Near(starts, ends)
        for s in sources:
            total += near.dependencies(s)
        return np.arange(n), total
    for own in np.split(sources, range(max(1, CELLS // n), len(sources), max(1, CELLS // n))):
        front = _matrix(starts, ends, None, own)
        seen, levels = front > 0, [front]
        seen[np.arange(len(own)), own] = True
        while not seen.all():
            front = _through(front, starts, ends, None)
            front[seen] = 0.0
            seen |= front > 0
            levels.append(front)
        delta = np.zeros((len(own), n))
        for near, far in zip(levels[-2::-1], levels[:0:-1], strict=True):
            delta += near * _through(np.divide(1 + delta, far, out=np.zeros_like(far), where=far > 0), starts, ends, None)
        total += delta.sum(axis=0)
    return np.arange(n), total


def _constraints_of(starts: np.ndarray, ends: np.ndarray, w: np.ndarray | None, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without weights, all are 1."""
    n = len(starts) - 1
    out = np.zeros(len(sources))
    near = _Near(starts, ends, w)
    totals = near.many.astype(float) if w is None else np.concatenate([np.add.reduceat(_taken(w, starts, own).astype(float), np.cumsum(near.many[own]) - near.many[own]) for own in _pieces(starts, np.arange(n))])
    if n * n <= 8 * len(ends) and n <= CELLS // 50:
        for k in range(0, len(sources), step := max(1, CELLS // n)):
            direct = _matrix(starts, ends, w, sources[k : k + step]) / totals[sources[k : k + step], None]
            out[k : k + step] = np.where(direct > 0, (direct + _through(direct / totals, starts, ends, w)) ** 2, 0.0).sum(axis=1)
        return sources, out
    for k, s in enumerate(sources):
        at = slice(starts[s], starts[s + 1])
        others = ends[at].astype(np.intp)
        p = (1.0 if w is None else w[at]) / np.full(len(others), totals[s])
        sent = np.zeros(n)
        sent[others] = p / totals[others]
        out[k] = ((p + near.gathered(sent, others)) ** 2).sum()
    return sources, out


def betweenness(edges: DataFrame, limit: int = LOCAL_EDGES, digits: int | None = 6) -> DataFrame:
    """(item, betweenness) of an undirected graph, scaled to the number of pairs of other nodes; ``digits`` None: not rounded.

    A graph of more than ``limit`` edges is not held by every task, but searched component by component.
    """
    if row_count_at_most(edges, limit):
        return _summed_over_sources(edges, limit, _dependencies, "betweenness", digits)
    found = _by_component(edges, _dependencies_of_all, "_s", False)
    n = found.count()
    value = F.coalesce("_s", F.lit(0.0)) / max((n - 1) * (n - 2), 1)
    return found.select("item", (value if digits is None else F.round(value, digits)).alias("betweenness"))


def load(edges: DataFrame, limit: int = LOCAL_EDGES, digits: int | None = 6) -> DataFrame:
    """(item, load): as :func:`betweenness`, but each node hands what it got on evenly, whatever the number of paths beyond."""
    return _summed_over_sources(edges, limit, _loads, "load", digits)


def directed_betweenness(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item, betweenness) of every node, a table (item), on directed (src, dst), scaled to ordered pairs of other nodes.

    All sources are searched at once, one level a round, by joins: for sparse graphs, where few nodes can be reached from one.
    """
    links = checkpointed(links.select("src", "dst").where("src <> dst").distinct())
    front = links.select(F.col("src").alias("s"), F.col("src").alias("v"), F.lit(1.0).alias("c")).distinct()
    seen, levels = front.select("s", "v"), []
    while True:
        steps = front.join(links.toDF("v", "w"), "v").join(seen.toDF("s", "w"), ["s", "w"], "left_anti")
        steps = checkpointed(steps.select("s", "v", "w", "c"))
        if steps.isEmpty():
            break
        front = checkpointed(steps.groupBy("s", "w").agg(F.sum("c").alias("c")).withColumnRenamed("w", "v"))
        levels.append((steps, front))
        seen = seen.unionByName(front.select("s", "v"))
    below, parts = None, None
    for steps, reached in reversed(levels):
        ends = reached.withColumn("d", F.lit(0.0)) if below is None else reached.join(below, ["s", "v"], "left").fillna(0.0, ["d"])
        ends = ends.select("s", F.col("v").alias("w"), ((F.col("d") + 1) / F.col("c")).alias("x"))
        below = checkpointed(steps.join(ends, ["s", "w"]).groupBy("s", "v").agg(F.sum(F.col("c") * F.col("x")).alias("d")))
        own = below.where("s <> v").groupBy(F.col("v").alias("item")).agg(F.sum("d").alias("d"))
        parts = own if parts is None else parts.unionByName(own)
    if parts is None:
        return nodes.select("item", F.lit(0.0).alias("betweenness"))
    n = nodes.count()
    total = parts.groupBy("item").agg(F.sum("d").alias("d"))
    return nodes.select("item").join(total, "item", "left").select("item", (F.coalesce("d", F.lit(0.0)) / max((n - 1) * (n - 2), 1)).alias("betweenness"))


def constraint_of_dense(edges: DataFrame, limit: int = LOCAL_EDGES) -> DataFrame:
    """(item, constraint), not rounded: ``constraint`` where a join of all two-step paths is too long.

    A graph of more than ``limit`` edges is not held by every task, but read component by component.
    """
    if not row_count_at_most(edges, limit):
        return _by_component(edges, _constraints_of, "constraint", True)
    spark = edges.sparkSession
    names, *arrays = _arrays(edges, limit)
    graph = spark.sparkContext.broadcast((names, *arrays))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, starts, ends, w = graph.value
        n = len(names)
        src = np.repeat(np.arange(n), np.diff(starts))
        p = w / np.bincount(src, w, n)[src]
        for d in it:
            out = []
            for i in d["id"]:
                q, direct = ends[starts[i] : starts[i + 1]], p[starts[i] : starts[i + 1]]
                many, at = _arcs_of(starts, q)
                two = np.zeros(n)
                np.add.at(two, ends[at], np.repeat(direct, many) * p[at])
                out.append((names[i], float(((direct + two[q]) ** 2).sum()) if len(q) else None))
            yield pd.DataFrame(out, columns=["item", "constraint"])

    kind = edges.schema["a"].dataType.simpleString()
    return spark.range(0, len(names), 1, spark.sparkContext.defaultParallelism).mapInPandas(run, f"item {kind}, constraint double")


def _distances(adj: dict, s):
    dist = {s: 0}
    queue = deque([s])
    while queue:
        v = queue.popleft()
        for w in adj.get(v, ()):
            if w not in dist:
                dist[w] = dist[v] + 1
                queue.append(w)
    yield (s, len(dist), float(sum(dist.values())), float(sum(1 / d for d in dist.values() if d)))


def closeness(edges: DataFrame, limit: int = LOCAL_EDGES) -> DataFrame:
    """(item, closeness, harmonic): closeness with the correction for the size of the component."""
    kind = edges.schema["a"].dataType.simpleString()
    parts = _from_each(edges, limit, _distances, f"item {kind}, reached bigint, far double, harmonic double")
    n = parts.agg(F.count("*").alias("_n"))
    r = F.col("reached") - 1
    value = F.when((F.col("far") > 0) & (F.col("_n") > 1), r / F.col("far") * r / (F.col("_n") - 1)).otherwise(0.0)
    return parts.crossJoin(F.broadcast(n)).select("item", F.round(value, 6).alias("closeness"), F.round("harmonic", 6).alias("harmonic"))  # one row


def label_communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(item, community) by label propagation: each node takes the label of the greatest weight around it, ties the smallest.

    A distributed stand-in for modularity on a collapsed graph; results differ from it.
    """
    links = checkpointed(both_ways(edges))
    labels = links.select(F.col("src").alias("item")).distinct().withColumn("community", F.col("item"))
    for k in range(rounds):
        votes = links.join(labels.select(F.col("item").alias("src"), "community"), "src").groupBy("dst", "community").agg(F.sum("w").alias("_v"))
        labels = votes.groupBy(F.col("dst").alias("item")).agg(F.min(F.struct((-F.col("_v")).alias("_v"), "community")).alias("_b")).select("item", F.col("_b.community").alias("community"))
        if k % CUT_EVERY == CUT_EVERY - 1:
            labels = checkpointed(labels)
    return labels


def _levels(start: DataFrame, step: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """``start`` and all that ``step`` makes of it round by round until nothing is left; an error after ``most`` rounds.

    Walks of an acyclic graph end; one with a cycle never does, and a walk of as many arcs as there are nodes has met one.
    """
    level, found = start, [start]
    for k in range(most + 1):
        level = checkpointed(step(level))
        if level.isEmpty():
            return _united(found)
        found.append(level)
        if len(found) == 4 * CUT_EVERY:
            found = [checkpointed(_united(found))]
    raise ValueError(f"a cycle, or chains of more than {most} arcs")


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _nodes(arcs: DataFrame, a: str, b: str) -> DataFrame:
    return checkpointed(arcs.select(F.col(a).alias("x")).union(arcs.select(b)).distinct())


def depths(cites: DataFrame, most: int = LONGEST_CHAIN) -> DataFrame:
    """(item, depth): the longest chain of citations below each paper of an acyclic graph (src cites dst).

    A paper stands in level k if a chain of k citations ends there. A cycle, or a chain longer than ``most``, is an error.
    """
    links = checkpointed(cites.select("src", "dst").distinct().repartition("dst"))
    items = _nodes(links, "src", "dst")
    up = lambda level: links.join(level.select(F.col("x").alias("dst"), "k"), "dst").groupBy(F.col("src").alias("x")).agg((F.max("k") + 1).alias("k"))
    found = _levels(items.withColumn("k", F.lit(0)), up, min(most, items.count()))
    return found.groupBy(F.col("x").alias("item")).agg(F.max("k").alias("depth"))


def path_weights(cites: DataFrame, kind: str = "spc", most: int = LONGEST_CHAIN) -> DataFrame:
    """(u, v, weight): knowledge flows u -> v of an acyclic citation graph (v cites u), weighted by path counts.

    spc: source-to-sink paths through the arc; splc: paths that start at any ancestor; spnp: ancestors times descendants, each
    counting itself. The counts are filled level by level, one join each. A cycle, or a chain longer than ``most``, is an error.
    """
    flow = checkpointed(cites.select(F.col("dst").alias("u"), F.col("src").alias("v")).distinct())
    nodes = _nodes(flow, "u", "v")
    most = min(most, nodes.count())
    if kind == "spnp":
        return _reach_weights(flow, most)

    def counts(edges: DataFrame, start: str) -> DataFrame:
        """Paths into each node: 1 at the sources ("source"), or 1 at every node ("any"), plus those of its predecessors."""
        first = nodes if start == "any" else nodes.join(edges.select(F.col("v").alias("x")).distinct(), "x", "left_anti")
        own = checkpointed(edges.repartition("u"))
        moved = lambda level: own.join(level.select(F.col("x").alias("u"), "c"), "u").groupBy(F.col("v").alias("x")).agg(F.sum("c").alias("c"))
        # a graph of cycles alone has no sources; its arcs would be lost without a word
        if start == "source" and not edges.isEmpty() and first.isEmpty():
            raise ValueError("a cycle: no node is without predecessors")
        return _levels(first.withColumn("c", F.lit(1.0)), moved, most).groupBy("x").agg(F.sum("c").alias("c"))

    down = counts(flow, "any" if kind == "splc" else "source")
    up = counts(flow.select(F.col("v").alias("u"), F.col("u").alias("v")), "source")
    return flow.join(down.toDF("u", "_a"), "u").join(up.toDF("v", "_b"), "v").select("u", "v", (F.col("_a") * F.col("_b")).alias("weight"))


def _reach_weights(flow: DataFrame, most: int) -> DataFrame:
    by_start = checkpointed(flow.select(F.col("u").alias("y"), "v").repartition("y"))
    step, total = flow.select(F.col("u").alias("x"), F.col("v").alias("y")), None
    for k in range(most + 1):
        total = step if total is None else checkpointed(total.unionByName(step)) if k % CUT_EVERY == 0 else total.unionByName(step)
        step = checkpointed(step.join(by_start, "y").select("x", F.col("v").alias("y")).distinct().join(total, ["x", "y"], "left_anti"))
        if step.isEmpty():
            break
    anc = total.groupBy(F.col("y").alias("u")).agg((F.count("*") + 1.0).alias("_a"))
    desc = total.groupBy(F.col("x").alias("v")).agg((F.count("*") + 1.0).alias("_b"))
    return flow.join(anc, "u", "left").join(desc, "v", "left").select("u", "v", (F.coalesce("_a", F.lit(1.0)) * F.coalesce("_b", F.lit(1.0))).alias("weight"))


def main_path(weights: DataFrame, most: int = LONGEST_CHAIN) -> DataFrame:
    """(step, u, v): the arcs of the chain of the greatest sum of weights, from its source to its best sink; ties to smaller ids.

    Every node points to the best node before it; the chain is read off by doubling the pointers, a few joins for any length.
    """
    arcs = checkpointed(weights.select("u", "v", "weight").repartition("u"))
    nodes = _nodes(arcs, "u", "v")
    start = nodes.select("x", F.lit(0.0).alias("s"), F.lit(None).cast(weights.schema["u"].dataType).alias("p"))

    def further(level: DataFrame) -> DataFrame:
        better = F.min(F.struct((-(F.col("s") + F.col("weight"))).alias("s"), F.col("u").alias("p"))).alias("_b")
        return arcs.join(level.select(F.col("x").alias("u"), "s"), "u").groupBy(F.col("v").alias("x")).agg(better).select("x", (-F.col("_b.s")).alias("s"), "_b.p")

    reached = _levels(start, further, min(most, nodes.count()))
    best = checkpointed(reached.groupBy("x").agg(F.min(F.struct((-F.col("s")).alias("s"), "p")).alias("_b")).select("x", (-F.col("_b.s")).alias("s"), "_b.p"))
    hop, on = best.where("p is not null").select("x", "p"), checkpointed(best.orderBy(F.col("s").desc(), "x").limit(1).select("x"))
    while not hop.isEmpty():
        on = checkpointed(on.unionAll(on.join(hop, "x").select(F.col("p").alias("x"))).distinct())
        hop = checkpointed(hop.join(hop.toDF("p", "_q"), "p").select("x", F.col("_q").alias("p")))
    place = F.row_number().over(Window.orderBy("s", "x")) - 1  # one row for each arc of the path
    return best.where("p is not null").join(on, "x", "left_semi").select(place.alias("step"), F.col("p").alias("u"), F.col("x").alias("v"))


def greedy_modularity(edges: DataFrame, limit: int = LOCAL_EDGES) -> DataFrame:
    """(item, community): the two communities whose joining adds most to modularity are joined until none adds any.

    For collapsed graphs, read as arrays and refused beyond ``limit`` edges: every step depends on all before it. Communities are
    numbered from 1, the largest first, then the one with the smallest item; ties of joins go to the smaller items.
    """
    names, starts, ends, w = _arrays(edges, limit)
    order = {k: r for r, k in enumerate(sorted(range(len(names)), key=lambda k: names[k]))}
    links: dict[int, dict[int, float]] = {order[k]: defaultdict(float) for k in range(len(names))}
    for v, many in enumerate(np.diff(starts)):
        for at in range(starts[v], starts[v] + many):
            links[order[v]][order[int(ends[at])]] += float(w[at])
    total = sum(sum(x.values()) for x in links.values()) or 1.0
    share = {v: sum(x.values()) / total for v, x in links.items()}
    gain = lambda a, b: 2 * (links[a][b] / total - share[a] * share[b])
    heap = [(-gain(a, b), a, b) for a in links for b in links[a] if a < b]
    heapq.heapify(heap)
    parts = {v: [v] for v in links}
    while heap:
        negative, a, b = heapq.heappop(heap)
        if a not in parts or b not in parts or -negative != gain(a, b):
            continue
        if negative >= 0:
            break
        parts[a] += parts.pop(b)
        share[a] += share.pop(b)
        for x, weight in links.pop(b).items():
            del links[x][b]
            if x != a:
                links[a][x] += weight
                links[x][a] += weight
        for x in links[a]:
            heapq.heappush(heap, (-gain(a, x), *sorted((a, x))))
    sorted_names = sorted(names)
    groups = sorted((sorted(p) for p in parts.values()), key=lambda p: (-len(p), p[0]))
    kind = edges.schema["a"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(sorted_names[v], k) for k, p in enumerate(groups, 1) for v in p], f"item {kind}, community int")


def _edge_betweenness(adj: dict) -> dict:
    """Betweenness of every undirected edge of a small graph."""
    total: dict = defaultdict(float)
    for s in adj:
        order, preds, sigma, dist = [], defaultdict(list), defaultdict(float), {s: 0}
        sigma[s] = 1.0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    preds[w].append(v)
        delta: dict = defaultdict(float)
        for w in reversed(order):
            for v in preds[w]:
                c = sigma[v] / sigma[w] * (1 + delta[w])
                total[min(v, w), max(v, w)] += c
                delta[v] += c
    return total


def _parts(adj: dict) -> list[set]:
    seen, out = set(), []
    for s in sorted(adj):
        if s not in seen:
            part, queue = {s}, deque([s])
            while queue:
                for w in adj[queue.popleft()]:
                    if w not in part:
                        part.add(w)
                        queue.append(w)
            seen |= part
            out.append(part)
    return out


def first_split(edges: DataFrame, limit: int = 20_000) -> DataFrame:
    """(item, part): the parts of a pruned graph after its most central edges are taken away until one more part appears.

    Runs on the driver on at most ``limit`` edges and refuses more; ties of edges go to the greatest pair.
    """
    adj = {k: set(v) for k, v in _adjacency(edges, limit).items()}
    start = len(_parts(adj))
    while adj and len(_parts(adj)) == start and any(adj.values()):
        scores = _edge_betweenness(adj)
        v, w = max(scores, key=lambda e: (round(scores[e], 9), e))
        adj[v].discard(w)
        adj[w].discard(v)
    kind = edges.schema["a"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(x, k) for k, part in enumerate(_parts(adj)) for x in sorted(part)], f"item {kind}, part int")
