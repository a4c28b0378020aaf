"""Edges from things that stand together: collaboration, coupling, co-citation, neighbours.

Mentions are made distinct within papers, and items of too few papers for any pair that counts are dropped before a paper's
items meet, so the pairs are only those that can count. A paper with very many items makes many pairs: its list is cut into
slices that meet each other in different tasks, and pairs are combined on the map side before they are shuffled.

Papers that are compared by their references meet through the rarest of them only, as many as the least similarity asks for;
papers with the same references are one class, whose first paper stands for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators.entity import presence
from quillmill.plans import broadcast_if_small, split_join, written
from quillmill.plans.pairing import PAIR_BLOCK
from quillmill.plans.ranking import ranked

#: Items of a paper in one slice.
SLICE = 500


def edges(mentions: DataFrame, item: str = "item", least: int = 1) -> DataFrame:
    """(a, b, w), a < b: papers that name both."""
    once = presence(mentions, item)
    if least > 1:
        once = once.join(once.groupBy("item").agg(F.count("*").alias("_c")).where(F.col("_c") >= least).select("item"), "item", "left_semi")
    per_paper = once.groupBy("doc_id").agg(F.array_sort(F.collect_list("item")).alias("_i")).where(F.size("_i") > 1)
    starts = lambda since: F.sequence(since, F.size("_i"), F.lit(SLICE))
    short = per_paper.where(F.size("_i") <= SLICE).select(F.col("_i").alias("_x"), F.col("_i").alias("_y"), F.lit(True).alias("_same"))
    slices = per_paper.where(F.size("_i") > SLICE).select("_i", F.explode(starts(F.lit(1))).alias("_s")).select("_i", "_s", F.explode(starts(F.col("_s"))).alias("_t"))
    cut = slices.repartition("_s", "_t").select(F.slice("_i", F.col("_s"), SLICE).alias("_x"), F.slice("_i", F.col("_t"), SLICE).alias("_y"), (F.col("_s") == F.col("_t")).alias("_same"))
    # two generators in a row, so that the pairs of a paper never stand in memory together
    first = short.unionAll(cut).select("_y", "_same", F.posexplode("_x").alias("_k", "a"))
    pairs = first.select("a", F.explode(F.when(F.col("_same"), F.slice("_y", F.col("_k") + 2, SLICE)).otherwise(F.col("_y"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("w")).where(F.col("w") >= least)


def numbered_edges(mentions: DataFrame, item: str = "item") -> tuple[DataFrame, DataFrame]:
    """:func:`edges` between the numbers of items, written, and the table (item, number) of all items: where nearly every pair is met, names fill the disk."""
    items = mentions.where(F.col(item).isNotNull()).select(F.col(item).alias("item")).distinct()
    names = written(ranked(items, [F.col("item")]).select("item", F.col("rank").cast("bigint").alias("number")), "names")
    found = mentions.select("doc_id", F.col(item).alias("item")).join(broadcast_if_small(names), "item").select("doc_id", F.col("number").alias("item"))
    return written(edges(found), "pairs"), names


def position_edges(mentions: DataFrame, item: str = "item") -> DataFrame:
    """(a, b, w): ordered pairs of different positions within papers; repeated items make loops and count again."""
    lists = mentions.where(F.col(item).isNotNull()).groupBy("doc_id").agg(F.collect_list(item).alias("_i")).where(F.size("_i") > 1)
    ends = lists.select("_i", F.posexplode("_i").alias("_k", "a")).select("_k", "a", F.posexplode("_i").alias("_j", "b")).where("_k <> _j")
    return ends.groupBy("a", "b").agg(F.count("*").alias("w"))


def partners(pairs: DataFrame) -> DataFrame:
    """(item, n_partners, strength) out of undirected edges."""
    both = pairs.select(F.col("a").alias("item"), "w").unionAll(pairs.select(F.col("b").alias("item"), "w"))
    return both.groupBy("item").agg(F.count("*").alias("n_partners"), F.sum("w").alias("strength"))


def ego(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(item, partner, w): the neighbours of chosen items, a table (item)."""
    both = pairs.select(F.col("a").alias("item"), F.col("b").alias("partner"), "w").unionByName(pairs.select(F.col("b").alias("item"), F.col("a").alias("partner"), "w"))
    return both.join(chosen.select("item"), "item", "left_semi")


def reference_classes(references: DataFrame, once: bool = False) -> DataFrame:
    """(doc_id, class_id): papers with the same references as often, or, with ``once``, at all; the smallest id names the class."""
    return _classes(references, once).select("doc_id", "class_id")


def _classes(references: DataFrame, once: bool) -> DataFrame:
    """(doc_id, class_id, _l): the list of (ref, n) too; classes are joined by two hashes of the lists, with no list shuffled twice."""
    counts = references.where("ref is not null").groupBy("doc_id", "ref").agg((F.lit(1) if once else F.count("*")).cast("bigint").alias("n"))
    lists = counts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ref", "n"))).alias("_l"))
    marked = written(lists.withColumns({"_h": F.xxhash64("_l"), "_g": F.xxhash64(F.lit("second"), "_l")}), "lists")
    first = marked.groupBy("_h", "_g").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("_n"))
    # a list that is alone is its own class, so only copies are looked up
    return marked.join(first.where("_n > 1").drop("_n"), ["_h", "_g"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "_l")


def _square(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda s, x: s + x["n"] * x["n"])


def _compared(references: DataFrame, once: bool, prefix: Column, may: Column) -> DataFrame:
    """(a, b, shared, dot, sa, sb), a < b: class representatives that can be similar, with the squares of their lengths.

    ``prefix``, a column of ``_r``, the list (papers that have it, ref, n), rarest first, is how many references a pair must meet through;
    those of few papers are taken too, so that the sums over the met references are mostly the whole. Pairs that lack some and ``may``
    be similar, a column of shared, dot, the squares sa and sb, what lacks of them, ra and rb, and in number, ma and mb, are summed anew.
    """
    reps = written(_classes(references, once).where("doc_id = class_id").select("doc_id", "_l"), "representatives")
    listed = reps.select("doc_id", F.explode("_l").alias("_x")).select("doc_id", "_x.ref", "_x.n")
    rare = listed.groupBy("ref").agg(F.count("*").alias("_c"))
    ranked = listed.join(rare, "ref").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_c", "ref", "n"))).alias("_r"))
    taken = F.greatest(prefix, F.size(F.filter("_r", lambda x: x["_c"] <= PAIR_BLOCK)))
    cut = written(ranked.withColumn("_k", taken).select("doc_id", F.slice("_r", F.lit(1), F.col("_k")).alias("_p"), _square(F.col("_r")).alias("s"), _square(F.slice("_r", F.col("_k") + 1, F.size("_r"))).alias("r"), (F.size("_r") - F.col("_k")).alias("m")), "probes")
    probes = cut.select("doc_id", F.explode("_p").alias("_x")).where("_x._c > 1").select("doc_id", "_x.ref", "_x.n")
    met = split_join(probes.toDF("a", "ref", "na"), probes.toDF("b", "ref", "nb"), ["ref"]).where("a < b")
    sums = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum(F.col("na") * F.col("nb")).alias("dot"))
    facts = broadcast_if_small(cut.select("doc_id", "s", "r", "m"))
    known = sums.join(facts.toDF("a", "sa", "ra", "ma"), "a").join(facts.toDF("b", "sb", "rb", "mb"), "b")
    out = ["a", "b", "shared", "dot", "sa", "sb"]
    if cut.where("m > 0").isEmpty():
        return known.select(out)
    again = known.where("ma > 0 or mb > 0").where(may).select("a", "b", "sa", "sb").join(reps.toDF("a", "_a"), "a").join(reps.toDF("b", "_b"), "b")
    whole = again.select("a", "b", _shared(lambda n, m: F.when(m.isNotNull(), 1).cast("bigint")).alias("shared"), _shared(lambda n, m: n * m).alias("dot"), "sa", "sb")
    return known.where("ma = 0 and mb = 0").select(out).unionByName(whole)


def _shared(weight) -> Column:
    """The sum of ``weight`` of the counts on both sides over the common references of two lists."""
    other = F.map_from_entries("_b")
    return F.aggregate("_a", F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(weight(x["n"], F.try_element_at(other, x["ref"])), F.lit(0)))


def coupling(references: DataFrame, least: float = 0.3) -> DataFrame:
    """(a, b, shared, cosine), a < b: papers by the cosine of their reference counts, each the first of its class.

    A class holds the papers with equal counts, whose cosine is 1 (see :func:`reference_classes`). Two lists with that cosine share
    one of the references that are left when the most common ones go as long as those alone stay below it; so nothing is lost.
    """
    n = F.size("_r")
    # the squares of the references from each place on, against the whole
    below = F.filter(F.sequence(F.lit(1), n), lambda k: _square(F.slice("_r", k, n)) < least * least * _square(F.col("_r")) * (1 - 1e-9))
    length = lambda c: F.sqrt(F.col(c).cast("double"))
    may = F.col("dot") + length("ra") * length("sb") + length("sa") * length("rb") >= least * length("sa") * length("sb") * (1 - 1e-9)
    pairs = _compared(references, False, F.coalesce(F.array_min(below) - 1, n), may)
    scored = pairs.withColumn("cosine", F.col("dot") / (length("sa") * length("sb")))
    return scored.where(F.col("cosine") >= least).select("a", "b", "shared", F.round("cosine", 6).alias("cosine"))


def shared_references(references: DataFrame, least: int) -> DataFrame:
    """(a, b, shared), a < b: papers with at least ``least`` references in common, each the first of those with the same set.

    Two papers that share so many share one of all but the ``least`` - 1 most common references of either.
    """
    pairs = _compared(references, True, F.greatest(F.lit(0), F.size("_r") - (least - 1)), F.col("shared") + F.col("ma") + F.col("mb") >= least)
    return pairs.where(F.col("shared") >= least).select("a", "b", "shared")


def cocited_with(references: DataFrame, target: str) -> DataFrame:
    """(ref, n): references that stand in papers which also cite ``target``."""
    citing = references.where(F.col("ref") == target).select("doc_id").distinct()
    return references.join(citing, "doc_id", "left_semi").where(F.col("ref") != target).select("doc_id", "ref").distinct().groupBy("ref").agg(F.count("*").alias("n"))


def incidence(references: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, ref, n): the sparse paper x reference matrix, references with at least ``least`` citations."""
    counts = references.groupBy("doc_id", "ref").agg(F.count("*").alias("n"))
    kept = counts.groupBy("ref").agg(F.sum("n").alias("_t")).where(F.col("_t") >= least)
    return counts.join(kept, "ref", "left_semi")


def map_edges(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """Edges with the coordinates of both ends; ``places`` is a table (item, lat, lon)."""
    p = broadcast_if_small(places)
    return pairs.join(p.toDF("a", "lat_a", "lon_a"), "a").join(p.toDF("b", "lat_b", "lon_b"), "b")
