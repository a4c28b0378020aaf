"""Terms over time: growth, bursts, adoption and the flow of concepts between entities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.operators.entity import presence


def term_growth(terms: DataFrame, papers: DataFrame, top: int) -> DataFrame:
    """(item, year, n, total): papers with each of the most frequent terms in each year, and their running sum."""
    once = presence(terms).join(papers.select("doc_id", "year"), "doc_id")
    by_year = once.groupBy("item", "year").agg(F.count("*").alias("n"))
    best = by_year.groupBy("item").agg(F.sum("n").alias("_t")).orderBy(F.col("_t").desc(), "item").limit(top).select("item")
    span = papers.agg(F.sequence(F.min("year"), F.max("year")).alias("_y")).select(F.explode("_y").alias("year"))
    full = best.crossJoin(F.broadcast(span)).join(by_year, ["item", "year"], "left").withColumn("n", F.coalesce("n", F.lit(0)))  # top x years
    return full.withColumn("total", F.sum("n").over(Window.partitionBy("item").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))


def top_terms_each_year(terms: DataFrame, papers: DataFrame, top: int) -> DataFrame:
    """(year, item, n, place): the most mentioned terms of each year."""
    counted = terms.where("item is not null").join(papers.select("doc_id", "year"), "doc_id").groupBy("year", "item").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("year").orderBy(F.col("n").desc(), "item"))
    return counted.withColumn("place", place).where(F.col("place") <= top)


def two_state_bursts(r: np.ndarray, d: np.ndarray, s: float = 2.0, gamma: float = 1.0) -> list[tuple[int, int, float]]:
    """(first, last, strength) of the bursts of a series: counts ``r`` out of ``d``, by the two-state automaton.

    Going up costs gamma, at the start too; ties favour the lower state.
    """
    if not d.sum() or not r.sum():
        return []
    p0 = r.sum() / d.sum()
    p1 = min(0.999, s * p0)
    p0 = min(p0, 0.999)
    cost = np.stack([-(r * np.log(p) + (d - r) * np.log(1 - p)) for p in (p0, p1)])
    n = len(r)
    best = np.zeros((2, n))
    came = np.zeros((2, n), int)
    best[:, 0] = cost[0, 0], cost[1, 0] + gamma
    for t in range(1, n):
        for state in (0, 1):
            from0, from1 = best[0, t - 1] + gamma * state, best[1, t - 1]
            came[state, t] = int(from1 < from0)
            best[state, t] = min(from0, from1) + cost[state, t]
    state, path = int(best[1, -1] < best[0, -1]), []
    for t in range(n - 1, -1, -1):
        path.append(state)
        state = came[state, t]
    path.reverse()
    out, start = [], None
    for t, x in enumerate([*path, 0]):
        if x and start is None:
            start = t
        elif not x and start is not None:
            out.append((start, t - 1, float((cost[0, start:t] - cost[1, start:t]).sum())))
            start = None
    return out


def bursts(terms: DataFrame, papers: DataFrame, least: int = 5, s: float = 2.0, gamma: float = 1.0) -> DataFrame:
    """(item, first_year, last_year, strength): bursts of every term with at least ``least`` mentions.

    Papers of each year are counted on the JVM side; Python gets one short series for each term. Papers without a year count nowhere.
    """
    if s <= 1 or gamma <= 0:
        raise ValueError("s is greater than 1 and gamma greater than 0")
    papers = papers.where("year is not null")
    per_year = papers.groupBy("year").agg(F.count("*").alias("d")).orderBy("year").collect()  # as many rows as years
    years = list(range(per_year[0]["year"], per_year[-1]["year"] + 1)) if per_year else []
    d = np.zeros(len(years))
    for row in per_year:
        d[row["year"] - years[0]] = row["d"]
    frequent = terms.where("item is not null").groupBy("item").agg(F.count("*").alias("_m")).where(F.col("_m") >= least)
    counted = presence(terms).join(frequent, "item", "left_semi").join(papers.select("doc_id", "year"), "doc_id").groupBy("item", "year").agg(F.count("*").alias("n"))
    series = counted.groupBy("item").agg(F.collect_list(F.struct("year", "n")).alias("s"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            rows = []
            for item, pairs in zip(batch["item"], batch["s"], strict=True):
                r = np.zeros(len(years))
                for p in pairs:
                    r[p["year"] - years[0]] = p["n"]
                rows += [(item, years[a], years[b], x) for a, b, x in two_state_bursts(r, d, s, gamma)]
            yield pd.DataFrame(rows, columns=["item", "first_year", "last_year", "strength"])

    return series.mapInPandas(run, "item string, first_year int, last_year int, strength double")


def first_adoption(entities: DataFrame, concepts: DataFrame, papers: DataFrame) -> DataFrame:
    """(concept, entity, first_year, delay): when an entity first used a concept, and years after the first entity did."""
    used = entities.join(concepts, "doc_id").join(papers.select("doc_id", "year"), "doc_id").groupBy("concept", "entity").agg(F.min("year").alias("first_year"))
    origin = used.groupBy("concept").agg(F.min("first_year").alias("_y"))
    return used.join(origin, "concept").select("concept", "entity", "first_year", (F.col("first_year") - F.col("_y")).alias("delay"))


def concept_flows(cites: DataFrame, entities: DataFrame, concepts: DataFrame) -> DataFrame:
    """(source, target, n, mean_delay): concepts that a citing paper shares with an earlier cited one, by entities.

    Lists of entities are not made distinct, so an entity named twice in a paper counts twice (the literal rule).
    """
    once = concepts.select("doc_id", "concept").distinct()
    links = cites.where("dst_year < src_year").select("src", "dst", (F.col("src_year") - F.col("dst_year")).alias("_d"))
    shared = links.join(once.toDF("dst", "concept"), "dst").join(once.toDF("src", "concept"), ["src", "concept"]).groupBy("src", "dst", "_d").agg(F.count("*").alias("_c"))
    counted = entities.groupBy("doc_id", "entity").agg(F.count("*").alias("_m"))
    moved = shared.join(counted.toDF("dst", "source", "_ms"), "dst").join(counted.toDF("src", "target", "_mt"), "src").where("source <> target")
    weight = F.col("_c") * F.col("_ms") * F.col("_mt")
    return moved.groupBy("source", "target").agg(F.sum(weight).alias("n"), F.round(F.sum(weight * F.col("_d")) / F.sum(weight), 2).alias("mean_delay"))


def union_terms(parts: list[DataFrame]) -> DataFrame:
    """(doc_id, item): the terms of several sources, such as keywords and words of titles, each once in a paper."""
    rows = [p.where("item is not null").select("doc_id", F.lower(F.trim("item")).alias("item")) for p in parts]
    out = rows[0]
    for p in rows[1:]:
        out = out.unionByName(p)
    return out.where("item <> '' and item <> 'unknown'").distinct()


def parsed_evolution(text: DataFrame, column: str = "text", top: int = 10) -> DataFrame:
    """(year, item, n) of texts such as ``1999: maps (3), networks (2) 2000: ...``, for the terms with the greatest sums; zeros where a year has none."""
    years = F.regexp_extract_all(F.col(column), F.lit("(\\d{4}):((?:(?!\\d{4}:)[^\\n])*)"), 0)
    entries = text.select(F.explode(years).alias("e")).select(F.substring("e", 1, 4).cast("int").alias("year"), F.explode(F.regexp_extract_all(F.expr("substring(e, 6)"), F.lit("([^,]+?)\\s\\((\\d+)\\)"), 0)).alias("x"))
    rows = entries.select("year", F.trim(F.regexp_replace("x", "\\s\\(\\d+\\)$", "")).alias("item"), F.regexp_extract("x", "\\((\\d+)\\)$", 1).cast("int").alias("n"))
    once = rows.groupBy("year", "item").agg(F.max("n").alias("n"))
    best = once.groupBy("item").agg(F.sum("n").alias("_t")).orderBy(F.col("_t").desc(), "item").limit(top).select("item")
    grid = once.select("year").distinct().crossJoin(F.broadcast(best))  # top x years
    return grid.join(once, ["year", "item"], "left").select("year", "item", F.coalesce("n", F.lit(0)).alias("n"))
