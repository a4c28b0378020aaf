"""Spellings joined by the similarity of their texts.

Similarity is the ratio of matching blocks, 2 M / (|a| + |b|), or that of their word sets. A ratio of t needs at least
t (|a| + |b|) / 2 common letters, so of each text's letters, numbered by occurrence and rarest first, only a prefix has to
meet that of the other: every pair that can reach the threshold meets, and most others do not.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators.composite import clean_name
from quillmill.operators.graph import components
from quillmill.plans import checkpointed, split_join


def block_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def token_similarity(a: str, b: str) -> float:
    """The share of common words, or the ratio of the sorted words if that is greater."""
    x, y = set(a.split()), set(b.split())
    share = len(x & y) / max(len(x), len(y), 1)
    return max(share, block_ratio(" ".join(sorted(x)), " ".join(sorted(y))))


def _score(method: str):
    def one(a: str, b: str) -> float:
        if method == "ratio":
            return block_ratio(a, b)
        token = token_similarity(a, b)
        return token if method == "token" else max(block_ratio(a, b), 0.96 * token)

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return score


def _letters(c: Column) -> Column:
    """The letters of a text, each with the number of its occurrence."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.transform(chars, lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


def similar_pairs(texts: DataFrame, text: str, least: float, method: str = "ratio", same_start: bool = False) -> DataFrame:
    """(a, b, score), a < b: distinct texts with ``least`` <= score; ``same_start`` asks for the same first letter.

    Methods: "ratio" by blocks, complete for every pair; "token" and "fuzzy" also score words, complete for pairs whose letters can
    reach the threshold. Null and empty texts have no pair.
    """
    rows = texts.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(text).alias("t")).distinct()
    first = F.substring("t", 1, 1) if same_start else F.lit("")
    floor = 0.96 * least if method == "fuzzy" else least
    listed = rows.select("t", first.alias("_s"), F.length("t").alias("_n"), F.explode(_letters(F.col("t"))).alias("x"))
    counted = listed.groupBy("x").agg(F.count("*").alias("_c"))
    keep = F.col("_n") - F.ceil(F.col("_n") * (floor / (2 - floor)) - 1e-6).cast("int") + 1
    prefix = listed.join(F.broadcast(counted), "x").groupBy("t", "_s", "_n").agg(F.array_sort(F.collect_list(F.struct("_c", "x"))).alias("_l"))  # as many rows as letters times occurrences
    probes = prefix.select("t", "_s", "_n", F.explode(F.slice("_l", F.lit(1), keep)).alias("_x")).select("t", "_s", "_n", F.col("_x.x").alias("x"))
    probes = checkpointed(probes)
    met = split_join(probes.toDF("a", "_s", "_na", "x"), probes.toDF("b", "_s", "_nb", "x"), ["_s", "x"]).where("a < b").where(F.least("_na", "_nb") * (2 - floor) + 1e-6 >= F.greatest("_na", "_nb") * floor).select("a", "b").distinct()
    return met.withColumn("score", F.round(_score(method)(F.col("a"), F.col("b")), 6)).where(F.col("score") >= least)


def normalized_entities(mentions: DataFrame, item: str = "item", method: str = "fuzzy", least: float = 0.88, min_count: int = 1) -> DataFrame:
    """(candidate, normalized, n): spellings and the most frequent spelling they are connected with."""
    counted = mentions.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("candidate")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    cleaned = counted.withColumn("_k", clean_name(F.col("candidate"))).where("_k <> ''")
    pairs = similar_pairs(cleaned, "_k", least, method, same_start=True)
    groups = components(pairs.select("a", "b"))
    named = cleaned.join(groups, F.col("_k") == F.col("item"), "left").withColumn("_g", F.coalesce("component", "_k"))
    best = named.groupBy("_g").agg(F.max_by("candidate", F.struct("n", "candidate")).alias("normalized"))
    return named.join(best, "_g").where("candidate <> normalized").select("candidate", "normalized", "n")
