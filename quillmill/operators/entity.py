"""Counting entities, their impact indices, and descriptions of a corpus.

A *mention* counts every occurrence; *presence* counts a paper once. Mentions are tables (doc_id, item); papers have
(doc_id, year, citation). Indices are computed from the histogram of citations of each entity, which is combined on the
map side and has no more rows than distinct citation counts, so an entity with a third of all papers burdens no task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.plans.ranking import ranked

# The steps of the j-index.
J_STEPS = (500, 250, 100, 50, 25, 10, 5, 4, 3, 2, 1.5, 1.25)


def mention_counts(mentions: DataFrame, item: str = "item") -> DataFrame:
    """(item, n): every occurrence counts."""
    return mentions.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.count("*").alias("n"))


def presence(mentions: DataFrame, item: str = "item") -> DataFrame:
    """(doc_id, item), each pair once."""
    return mentions.where(F.col(item).isNotNull()).select("doc_id", F.col(item).alias("item")).distinct()


def presence_counts(mentions: DataFrame, papers: DataFrame, item: str = "item") -> DataFrame:
    """(item, n_docs, citations): each paper counts once for an entity."""
    cited = presence(mentions, item).join(papers.select("doc_id", "citation"), "doc_id")
    return cited.groupBy("item").agg(F.count("*").alias("n_docs"), F.sum("citation").alias("citations"))


def _histogram(mentions: DataFrame, papers: DataFrame, item: str, once: bool) -> DataFrame:
    rows = presence(mentions, item) if once else mentions.select("doc_id", F.col(item).alias("item"))
    cited = rows.join(papers.select("doc_id", "citation"), "doc_id").withColumn("citation", F.coalesce("citation", F.lit(0)))
    return cited.groupBy("item", "citation").agg(F.count("*").alias("n"))


def h_index(mentions: DataFrame, papers: DataFrame, item: str = "item", once: bool = True) -> DataFrame:
    """(item, h): the h-index alone, in one pass over the histogram."""
    above = Window.partitionBy("item").orderBy(F.col("citation").desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = _histogram(mentions, papers, item, once).withColumn("_upto", F.sum("n").over(above))
    return steps.groupBy("item").agg(F.max(F.least(F.col("citation").cast("long"), F.col("_upto"))).alias("h"))


def impact_indices(mentions: DataFrame, papers: DataFrame, current_year: int, item: str = "item", once: bool = True) -> DataFrame:
    """(item, h, g, e, m, j) of every entity.

    With ``once`` false an entity listed twice in a paper counts that paper twice. m is null without a usable year;
    years below 1 are not usable. j adds to h the weighted numbers of papers cited at least h times a step.
    """
    histogram = _histogram(mentions, papers, item, once)
    above = Window.partitionBy("item").orderBy(F.col("citation").desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = histogram.withColumn("_upto", F.sum("n").over(above)).withColumn("_sum", F.sum(F.col("n") * F.col("citation")).over(above))
    n0, s0, c = F.col("_upto") - F.col("n"), F.col("_sum") - F.col("n") * F.col("citation"), F.col("citation")
    root = F.floor((c + F.sqrt((c * c + 4 * (s0 - c * n0)).cast("double"))) / 2).cast("long")
    fits = lambda r: s0 + (r - n0) * c >= r * r
    best = F.when(fits(root + 1), root + 1).when(fits(root), root).otherwise(root - 1)
    g = F.when(F.least(best, F.col("_upto")) > n0, F.least(best, F.col("_upto"))).otherwise(0)
    hg = steps.groupBy("item").agg(F.max(F.least(c.cast("long"), F.col("_upto"))).alias("h"), F.max(g).alias("g"))
    joined = histogram.join(hg, "item")
    weights = [1.0 / k for k in range(1, len(J_STEPS) + 1)]
    excess = F.sum(F.when(c > F.col("h"), (c - F.col("h")) * F.col("n")).otherwise(0))
    near = sum((F.sum(F.when(c >= F.col("h") * float(d), F.col("n")).otherwise(0)) * w for d, w in zip(J_STEPS, weights, strict=True)), F.lit(0.0))
    out = joined.groupBy("item", "h", "g").agg(F.sqrt(excess.cast("double")).alias("e"), near.alias("_near"))
    out = out.withColumn("j", F.when(F.col("h") > 0, F.col("h") + F.col("_near") / sum(weights)).otherwise(F.lit(0.0))).drop("_near")
    first = mentions.select("doc_id", F.col(item).alias("item")).join(papers.where("year > 0").select("doc_id", "year"), "doc_id").groupBy("item").agg(F.min("year").alias("_first"))
    m = F.col("h") / F.greatest(F.lit(1), F.lit(current_year) - F.col("_first") + 1)
    return out.join(first, "item", "left").select("item", "h", "g", "e", m.alias("m"), "j")


def top(df: DataFrame, by: str, n: int, tie: str = "item") -> DataFrame:
    """The ``n`` rows with the greatest ``by``, ties by ``tie``; a TakeOrdered, not a sort of all."""
    return df.orderBy(F.col(by).desc(), F.col(tie)).limit(n)


def per_year(papers: DataFrame) -> DataFrame:
    """(year, n_docs, citations) for every year between the first and the last, years without papers too."""
    counted = papers.where("year is not null").groupBy("year").agg(F.count("*").alias("n_docs"), F.sum("citation").alias("citations"))
    spine = counted.agg(F.sequence(F.min("year"), F.max("year")).alias("_y")).select(F.explode("_y").alias("year"))
    return spine.join(counted, "year", "left").select("year", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("citations", F.lit(0)).alias("citations"))


def productivity(mentions: DataFrame, papers: DataFrame, item: str = "item", once: bool = True) -> DataFrame:
    """(item, year, n): papers, or mentions, of each entity in each year."""
    rows = presence(mentions, item) if once else mentions.where(F.col(item).isNotNull()).select("doc_id", F.col(item).alias("item"))
    return rows.join(papers.select("doc_id", "year"), "doc_id").groupBy("item", "year").agg(F.count("*").alias("n"))


def lotka(mentions: DataFrame, item: str = "item") -> DataFrame:
    """(n_docs, n_authors): how many entities have how many papers."""
    return presence(mentions, item).groupBy("item").agg(F.count("*").alias("n_docs")).groupBy("n_docs").agg(F.count("*").alias("n_authors"))


def bradford(papers: DataFrame, source: str = "journal") -> DataFrame:
    """(item, n_docs, running, zone): sources by papers, cut in three zones of about equal numbers of papers."""
    counted = papers.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("item")).agg(F.count("*").alias("n_docs"))
    total = counted.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    one, two = total // 3, 2 * total // 3
    rows = ranked(counted, [F.col("n_docs").desc(), F.col("item")], "n_docs")
    return rows.select("item", "n_docs", "running", F.when(F.col("running") <= one, 1).when(F.col("running") <= two, 2).otherwise(3).alias("zone"))


def team_sizes(mentions: DataFrame, papers: DataFrame, item: str = "item") -> DataFrame:
    """(year, n_authors, n_docs) with the Total over all years (year null), from one rollup."""
    sizes = presence(mentions, item).groupBy("doc_id").agg(F.count("*").alias("n_authors")).join(papers.select("doc_id", "year"), "doc_id")
    cube = sizes.groupBy("n_authors", "year").agg(F.count("*").alias("n_docs"))
    return cube.unionByName(cube.groupBy("n_authors").agg(F.sum("n_docs").alias("n_docs")).withColumn("year", F.lit(None).cast("int"))).select("year", "n_authors", "n_docs")


def collaboration_index(mentions: DataFrame, papers: DataFrame, item: str = "item") -> DataFrame:
    """(year, ci): the mean place of a paper's team size among the sizes that occur, from 1; year null for all years.

    The weight is the place of the size among the occurring sizes, not the size: the literal rule.
    """
    counted = team_sizes(mentions, papers, item)
    places = counted.select("n_authors").distinct().withColumn("_p", F.row_number().over(Window.orderBy("n_authors")))  # as many rows as team sizes
    return counted.join(F.broadcast(places), "n_authors").groupBy("year").agg(F.round(F.sum(F.col("_p") * F.col("n_docs")) / F.sum("n_docs"), 2).alias("ci"))


#: The fields of the report on a corpus's health.
HEALTH = ("abbrev_source_title", "abstract", "affiliation", "author", "doi", "author_keywords", "keywords", "references", "year")


def averages(authors: DataFrame, institutions: DataFrame, papers: DataFrame) -> DataFrame:
    """(kpi, value): documents and citations per entity, team sizes and the greatest h-index; mentions are (doc_id, item). To two places."""
    docs = papers.agg(F.count("*").alias("docs"), F.sum("citation").alias("c"), F.countDistinct("journal").alias("j"), (F.max("year") - F.min("year") + 1).alias("y"))
    once = presence(authors)
    a = once.agg(F.count("*").alias("ad"), F.countDistinct("item").alias("a"))
    i = presence(institutions).agg(F.count("*").alias("id"), F.countDistinct("item").alias("i"))
    team = once.groupBy("doc_id").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("multi"), F.avg("k").alias("team"))
    h = h_index(authors, papers).agg(F.max("h").alias("h"))
    one = docs.crossJoin(a).crossJoin(i).crossJoin(team).crossJoin(h)  # one row each
    per = lambda x, y: F.try_divide(F.col(x), F.col(y))
    values = {
        "documents_per_author": per("ad", "a"), "documents_per_institution": per("id", "i"), "documents_per_source": per("docs", "j"), "documents_per_year": per("docs", "y"), "citations_per_author": per("c", "a"),
        "citations_per_institution": per("c", "i"), "citations_per_document": per("c", "docs"), "citations_per_source": per("c", "j"), "multi_author_documents": F.col("multi"), "authors_per_document": F.col("team"), "max_h_index": F.col("h"),
    }
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kpi"), F.round(c.cast("double"), 2).alias("value")) for k, c in values.items()))))


def known(c: Column) -> Column:
    """Neither null nor a word for unknown."""
    return F.coalesce(~F.lower(F.trim(c)).isin("", "unknown"), F.lit(False))


def health(papers: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n_known, share): how many cells are filled, in one pass."""
    parts = papers.agg(F.count("*").alias("_all"), *(F.count_if(known(F.col(f"`{f}`").cast("string"))).alias(f) for f in fields))
    long = parts.select("_all", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("n_known")) for f in fields))))
    return long.select("field", "n_known", F.round(F.try_divide(100.0 * F.col("n_known"), F.col("_all")), 2).alias("share"))
