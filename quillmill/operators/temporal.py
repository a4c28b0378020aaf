"""A typed graph of papers, their attributes and their references over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators.text import trigram_pairs


def node_id(kind: str, value: Column) -> Column:
    """A short id that a kind and a value always get."""
    return F.concat(F.lit(f"{kind}_"), F.substring(F.md5(F.lower(F.trim(value))), 1, 12))


def typed_edges(papers: DataFrame, attributes: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(src, dst, relation, year, n): from each paper to each of its attributes; ``attributes``: kind -> (mentions, column)."""
    years = papers.select("doc_id", "year")
    out = None
    for kind, (mentions, column) in attributes.items():
        rows = mentions.where(F.col(column).isNotNull()).select("doc_id", column).join(years, "doc_id").groupBy(node_id("paper", F.col("doc_id").cast("string")).alias("src"), node_id(kind, F.col(column).cast("string")).alias("dst"), "year").agg(F.count("*").alias("n"))
        part = rows.select("src", "dst", F.lit(f"paper_{kind}").alias("relation"), "year", "n")
        out = part if out is None else out.unionByName(part)
    return out


def typed_nodes(edges: DataFrame) -> DataFrame:
    """(node, kind, degree, first_year, last_year) of typed edges."""
    ends = edges.select(F.col("src").alias("node"), "year").unionAll(edges.select("dst", "year"))
    return ends.groupBy("node", F.substring_index("node", "_", 1).alias("kind")).agg(F.count("*").alias("degree"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def leading_part(papers: DataFrame, attributes: dict[str, tuple[DataFrame, str]], references: DataFrame, top_papers: int = 500, top_references: int = 300, least: int = 2) -> DataFrame:
    """:func:`typed_edges` of the most cited papers, to their attributes and to the references that most of them cite.

    Papers are ranked by citations, then by the smaller id; a reference needs ``least`` of them, and ties go to the smaller text. Both
    numbers are what a reader can look at; :func:`typed_edges` itself takes everything.
    """
    best = F.broadcast(papers.orderBy(F.coalesce("citation", F.lit(0)).desc(), "doc_id").limit(top_papers).select("doc_id"))
    cited = references.where("ref is not null").select("doc_id", "ref").join(best, "doc_id", "left_semi")
    counted = cited.distinct().groupBy("ref").agg(F.count("*").alias("_c")).where(F.col("_c") >= least)
    kept = cited.join(F.broadcast(counted.orderBy(F.col("_c").desc(), "ref").limit(top_references).select("ref")), "ref", "left_semi")
    own = {k: (m.where(F.col(c).isNotNull()).select("doc_id", c).join(best, "doc_id", "left_semi"), c) for k, (m, c) in attributes.items()}
    return typed_edges(papers, own | {"reference": (kept, "ref")})


def paper_indicators(papers: DataFrame, betweenness: DataFrame, authors: DataFrame, keywords: DataFrame, references: DataFrame, cites: DataFrame) -> DataFrame:
    """(item, citation, betweenness, n_authors, n_keywords, n_references, n_internal, score): one row for each paper.

    ``betweenness`` is (item, betweenness) of the paper graph; counts are of distinct names, and of references as they are listed.
    """
    distinct = lambda df, c, name: df.where(F.col(c).isNotNull()).select(F.col("doc_id").alias("item"), c).distinct().groupBy("item").agg(F.count("*").alias(name))
    listed = references.groupBy(F.col("doc_id").alias("item")).agg(F.count("*").alias("n_references"))
    inside = cites.select("src", "dst").distinct().groupBy(F.col("src").alias("item")).agg(F.count("*").alias("n_internal"))
    out = papers.select(F.col("doc_id").alias("item"), F.coalesce("citation", F.lit(0)).alias("citation")).join(betweenness, "item", "left")
    for part in (distinct(authors, "author", "n_authors"), distinct(keywords, "keyword", "n_keywords"), listed, inside):
        out = out.join(part, "item", "left")
    filled = out.fillna(0, ["betweenness", "n_authors", "n_keywords", "n_references", "n_internal"])
    return filled.join(bridge_scores(filled.select("item", "betweenness"), filled.select("item", "citation")), "item")


def reference_indicators(references: DataFrame, papers: DataFrame) -> DataFrame:
    """(ref, n, first_year, last_year, span): how often and from when to when each reference is cited; years below 1 do not count."""
    dated = references.where("ref is not null").select("doc_id", "ref").distinct().join(papers.where("year > 0").select("doc_id", "year"), "doc_id")
    return dated.groupBy("ref").agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year")).withColumn("span", F.col("last_year") - F.col("first_year"))


def bridge_scores(betweenness: DataFrame, citations: DataFrame) -> DataFrame:
    """(item, score): 0.7 times betweenness and 0.3 times saturated citations, c / (c + 50); to four places."""
    c = F.coalesce(F.col("citation"), F.lit(0)).cast("double")
    return betweenness.join(citations, "item", "left").select("item", F.round(0.7 * F.col("betweenness") + 0.3 * F.least(c / F.greatest(F.lit(1.0), c + 50), F.lit(1.0)), 4).alias("score"))


def internal_references(papers: DataFrame, references: DataFrame, least: float = 0.7) -> DataFrame:
    """(doc_id, ref, target): references that name a paper of the corpus, by DOI, then by title, then by author and year.

    ``papers``: (doc_id, doi, title, author, year); ``references``: (doc_id, ref, doi, title, author, year). A later step sees only
    what the earlier ones left; ties go to the smallest target.
    """
    key = ["doc_id", "ref"]
    low = lambda c: F.lower(F.trim(F.col(c)))

    def step(left: DataFrame, on: list[str]) -> DataFrame:
        there = papers.select(F.col("doc_id").alias("target"), *(low(c).alias(f"_{c}") for c in on)).dropna()
        hits = left.select(*key, *(low(c).alias(f"_{c}") for c in on)).dropna().join(there, [f"_{c}" for c in on]).where("doc_id <> target")
        return hits.groupBy(*key).agg(F.min("target").alias("target"))

    found = step(references, ["doi"])
    left = references.join(found, key, "left_anti")
    mine = left.where("title is not null").select(F.concat_ws("|", F.col("doc_id").cast("string"), "ref").alias("k"), "title", *key)
    theirs = papers.where("title is not null").select(F.col("doc_id").cast("string").alias("k"), "title", F.col("doc_id").alias("target"))
    near = trigram_pairs(theirs.select("k", "title"), mine.select("k", "title"), "k", "title", least)
    titled = near.join(theirs.select(F.col("k").alias("a"), "target"), "a").join(mine.select(F.col("k").alias("b"), *key), "b").where("doc_id <> target").groupBy(*key).agg(F.max_by("target", F.struct("jaccard", (-F.col("target")).alias("_n"))).alias("target"))
    found = found.unionByName(titled)
    return found.unionByName(step(references.join(found, key, "left_anti"), ["author", "year"]))
