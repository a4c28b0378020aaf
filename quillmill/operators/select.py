"""Choosing and joining papers: predicates, core sources, unions, keeping the first of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import clean
from quillmill.operators.entity import bradford
from quillmill.plans.ranking import ranked

#: Zones named by a code of the Bradford filter.
CORES = {1: (1,), 2: (2,), 3: (3,), 12: (1, 2), 23: (2, 3)}


def filter_papers(papers: DataFrame, doc_types: list[str] | None = None, years: tuple[int | None, int | None] = (None, None), sources: list[str] | None = None, core: int | None = None, languages: list[str] | None = None, abstract: bool = False) -> DataFrame:
    """The papers that pass every condition given; plain predicates reach the scan, the core is taken of what they leave.

    Years are compared as numbers (the documented intent, not the comparison of texts).
    """
    out = papers
    if doc_types:
        out = out.where(F.col("document_type").isin(doc_types))
    for limit, at_least in zip(years, (True, False), strict=True):
        if limit is not None:
            out = out.where(F.col("year") >= limit if at_least else F.col("year") <= limit)
    if sources:
        out = out.where(F.col("journal").isin(sources))
    if languages:
        out = out.where(F.col("language").isin(languages))
    if abstract:
        out = out.where(~clean.is_missing(F.col("abstract")))
    if core is not None:
        zones = bradford(out).where(F.col("zone").isin(*CORES[core])).select(F.col("item").alias("journal"))
        out = out.join(zones, "journal", "left_semi").select(out.columns)
    return out


def with_any(papers: DataFrame, mentions: DataFrame, items: list[str], item: str = "item") -> DataFrame:
    """Papers that mention any of ``items``."""
    return papers.join(mentions.where(F.col(item).isin(items)).select("doc_id").distinct(), "doc_id", "left_semi")


def title_key(c: Column) -> Column:
    """Small letters without digits, special characters and outer blanks; apostrophes stay. Missing titles are "nan"."""
    letters = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit("nan"))), "[^a-z0-9' ]+", " "), "[0-9]+", "")
    return F.trim(F.regexp_replace(letters, " +", " "))


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The rows with the smallest ``order`` of their key; found by an aggregation, so a frequent key burdens no task."""
    first = df.groupBy(key.alias("_key")).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")


def first_of_duplicates(papers: DataFrame, order: str, doi: str = "doi", title: str = "title") -> DataFrame:
    """Papers of which no earlier paper has the DOI or the cleaned title.

    The literal rule: every earlier row counts, kept or not; titles that differ in digits only are the same; missing DOIs
    are no duplicates. Ties of ``order`` are one paper.
    """
    doi_key = F.when(~clean.is_missing(F.col(doi)), F.lower(clean.squeezed(F.col(doi))))
    rows = papers.select(order, doi_key.alias("_d"), title_key(F.col(title)).alias("_t"))
    titles = rows.groupBy("_t").agg(F.min(order).alias(order)).select(order)
    dois = rows.where("_d is not null").groupBy("_d").agg(F.min(order).alias(order)).select(order).unionByName(rows.where("_d is null").select(order))
    return papers.join(titles, order, "left_semi").join(dois, order, "left_semi")


def union_corpora(old: DataFrame, new: DataFrame, order: str, **kw: str) -> DataFrame:
    """Both corpora with the columns of either, duplicates resolved in favour of the old one; missing cells are UNKNOWN.

    ``order`` must be a number; the new corpus is ordered behind the old one.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    texts = [f.name for f in both.schema.fields if f.dataType.simpleString() == "string"]
    both = both.fillna("UNKNOWN", texts).withColumn("_order", F.struct("_new", order))
    return first_of_duplicates(both, "_order", **kw).drop("_new", "_order")


def merge_spellings(df: DataFrame, column: str, get: list[str], replace_for: str) -> DataFrame:
    """``column`` in small letters, each text of ``get`` replaced wherever it is contained."""
    c = F.lower(F.col(column))
    for g in get:
        c = F.when(c.contains(g.lower()), F.replace(c, F.lit(g.lower()), F.lit(replace_for.lower()))).otherwise(c)
    return df.withColumn(column, c)


def at_positions(papers: DataFrame, order: str, positions: list[int]) -> DataFrame:
    """The papers at the given places, from 0, in the order of a column without ties; places beyond the end give nothing."""
    return ranked(papers, [F.col(order)]).where((F.col("rank") - 1).isin(positions)).drop("rank")


def with_keywords(papers: DataFrame, phrases: DataFrame, order: str = "doc_id") -> DataFrame:
    """``papers`` with ``keywords`` replaced by the phrases, (doc_id, pos, phrase), of each; papers without any have UNKNOWN."""
    joined = phrases.groupBy(order).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "phrase"))), lambda x: x["phrase"]), "; ").alias("_k"))
    return papers.drop("keywords").join(joined, order, "left").withColumn("keywords", F.coalesce("_k", F.lit("UNKNOWN"))).drop("_k")
