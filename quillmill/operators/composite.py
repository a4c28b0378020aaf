"""Composite measures of entities: portfolios, specialisation, collaboration, brokerage, profiles, name variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import clean
from quillmill.operators.cooccur import numbered_edges
from quillmill.operators.entity import impact_indices, presence
from quillmill.operators.graph import betweenness, degree
from quillmill.plans import broadcast_if_small


def leading(stats: DataFrame, top: int, production: str = "n_docs", impact: str = "impact", key: str = "item") -> DataFrame:
    """The ``top`` rows by the sum of the standard scores of production and impact; ties by ``key``."""
    means = stats.agg(*(f(c).alias(f"_{k}{c}") for c in (production, impact) for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    score = sum(((F.col(c) - F.col(f"_m{c}")) / (F.col(f"_s{c}") + 1e-12) for c in (production, impact)), F.lit(0.0))
    return stats.crossJoin(F.broadcast(means)).withColumn("_z", F.round(score, 9)).orderBy(F.col("_z").desc(), key).limit(top).select(stats.columns)  # one row


def portfolio(stats: DataFrame, production: str = "n_docs", impact: str = "impact", cuts: str | tuple[float, float] = "median") -> DataFrame:
    """``stats`` with ``quadrant`` by production and impact; on the line counts as above. ``cuts``: median, mean, or two numbers."""
    one = (lambda c: F.avg(c)) if cuts == "mean" else (lambda c: F.percentile(c, F.lit(0.5)))
    if isinstance(cuts, str):
        if cuts not in ("median", "mean"):
            raise ValueError("cuts are median, mean or two numbers")
        cuts = stats.agg(one(production).alias("_p"), one(impact).alias("_i"))
    else:
        cuts = stats.agg(F.lit(float(cuts[0])).alias("_p"), F.lit(float(cuts[1])).alias("_i"))
    both = stats.crossJoin(F.broadcast(cuts))  # one row
    high, strong = F.col(production) >= F.col("_p"), F.col(impact) >= F.col("_i")
    kind = F.when(high & strong, "Stars").when(~high & strong, "Emerging").when(high & ~strong, "Mature/Core").otherwise("Marginal")
    return both.withColumn("quadrant", kind).drop("_p", "_i")


def specialization(entities: DataFrame, fields: DataFrame, top: int, least: int = 1) -> DataFrame:
    """(entity, field, n, ai, si, share): activity of an entity in a field against its own and the field's margins.

    Margins are taken over the retained labels: the ``top`` most frequent of each side with at least ``least`` papers.
    """
    e, f = presence(entities).toDF("doc_id", "entity"), presence(fields).toDF("doc_id", "field")

    def kept(df: DataFrame, c: str) -> DataFrame:
        return F.broadcast(df.groupBy(c).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).orderBy(F.col("_n").desc(), c).limit(top).select(c))

    cells = e.join(kept(e, "entity"), "entity").join(f.join(kept(f, "field"), "field"), "doc_id").groupBy("entity", "field").agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy("entity").agg(F.sum("n").alias("_r")), cells.groupBy("field").agg(F.sum("n").alias("_c"))
    total = cells.agg(F.sum("n").alias("_t"))
    all_ = cells.join(F.broadcast(rows), "entity").join(F.broadcast(cols), "field").crossJoin(F.broadcast(total))  # top rows each
    ai = (F.col("n") / F.col("_r")) / (F.col("_c") / F.col("_t"))
    return all_.select("entity", "field", "n", F.round(ai, 4).alias("ai"), F.round((ai - 1) / (ai + 1), 4).alias("si"), F.round(F.col("n") / F.col("_r"), 4).alias("share"))


def collaboration_impact(entities: DataFrame, papers: DataFrame, item: str = "item") -> DataFrame:
    """(item, n_docs, n_solo, n_collab, rate, mean_solo, mean_collab, ratio); ratio is null where nothing solo is cited."""
    rows = presence(entities, item)
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("_k"))
    cited = rows.join(sizes, "doc_id").join(papers.select("doc_id", "citation"), "doc_id")
    solo, collab = F.col("_k") == 1, F.col("_k") > 1
    out = cited.groupBy("item").agg(
        F.count("*").alias("n_docs"), F.count_if(solo).alias("n_solo"), F.count_if(collab).alias("n_collab"),
        F.avg(F.when(solo, F.col("citation"))).alias("_s"), F.avg(F.when(collab, F.col("citation"))).alias("_c"),
    )
    return out.select("item", "n_docs", "n_solo", "n_collab", F.round(F.col("n_collab") / F.col("n_docs"), 6).alias("rate"), F.round("_s", 6).alias("mean_solo"), F.round("_c", 6).alias("mean_collab"), F.round(F.when(F.col("_s") > 0, F.col("_c") / F.col("_s")), 6).alias("ratio"))


def brokerage(parts: DataFrame) -> DataFrame:
    """(item, score) from (item, betweenness, strength, constraint, n_docs): a weighted sum of min-max scaled parts.

    A part that is the same for all scales to 0.5; a missing constraint counts as the greatest.
    """
    names = ("betweenness", "strength", "constraint", "n_docs")
    filled = parts.crossJoin(F.broadcast(parts.agg(F.max("constraint").alias("_cm")))).withColumn("constraint", F.coalesce("constraint", "_cm", F.lit(0.0))).drop("_cm")
    ends = filled.agg(*(f(n).alias(f"_{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))))
    both = filled.crossJoin(F.broadcast(ends))  # one row

    def scaled(n: str) -> Column:
        lo, hi = F.col(f"_lo_{n}"), F.col(f"_hi_{n}")
        return F.when(hi > lo, (F.col(n) - lo) / (hi - lo)).otherwise(0.5)

    score = 0.45 * scaled("betweenness") + 0.25 * scaled("strength") + 0.20 * (1 - scaled("constraint")) + 0.10 * scaled("n_docs")
    return both.select("item", F.round(score, 6).alias("score"))


def collaboration_network(entities: DataFrame, papers: DataFrame, digits: int = 6) -> DataFrame:
    """:func:`collaboration_impact` with the degree, strength and betweenness of each entity in the graph of those that share papers; 0 for those alone."""
    pairs, names = numbered_edges(entities)
    found = degree(pairs).select("item", "degree", "strength").join(betweenness(pairs, digits=digits), "item").withColumnRenamed("item", "number")
    out = collaboration_impact(entities, papers).join(names.join(found, "number").drop("number"), "item", "left")
    return out.fillna(0, ["degree", "strength", "betweenness"])


def profile_indices(mentions: DataFrame, papers: DataFrame, name: str, current_year: int) -> DataFrame:
    """(kind, value, n) with the h, g, e and j index of one entity, e and j to two places; only its own papers are read."""
    own = mentions.where(F.col("item") == name)
    rows = impact_indices(own, papers, current_year).select(*(F.round(F.col(k).cast("double"), 2).alias(k) for k in ("h", "g", "e", "j")))
    return rows.select(F.inline(F.array(*(F.struct(F.lit(f"{k}_index").alias("kind"), F.lit("").alias("value"), F.col(k).alias("n")) for k in ("h", "g", "e", "j")))))


def profile(mentions: DataFrame, papers: DataFrame, name: str, others: dict[str, DataFrame]) -> DataFrame:
    """(kind, value, n) of one entity: its papers, citations, first and last year, and its partners in other mentions."""
    own = presence(mentions).where(F.col("item") == name).select("doc_id")
    rows = papers.join(own, "doc_id", "left_semi")
    numbers = rows.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("citation"), F.lit(0)).alias("citations"), F.min("year").cast("long").alias("first_year"), F.max("year").cast("long").alias("last_year"))
    out = numbers.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit("").alias("value"), F.col(k).alias("n")) for k in ("n_docs", "citations", "first_year", "last_year")))))
    for kind, other in others.items():
        met = presence(other).join(own, "doc_id", "left_semi").where(F.col("item") != name)
        out = out.unionByName(met.groupBy("item").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.col("item").alias("value"), "n"))
    return out


def clean_name(c: Column) -> Column:
    """Small letters without accents, & as and, apostrophes off, anything else than letters and digits a blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(clean.without_accents(F.lower(c)), F.lit("&"), F.lit(" and ")), "['’`]", ""), "[^\\p{L}\\p{N}]+", " "))


def exact_clean_names(mentions: DataFrame, item: str = "item") -> DataFrame:
    """(candidate, normalized): spellings that agree after cleaning, named by the most frequent of them; what cleans to nothing agrees with nothing."""
    counted = mentions.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("candidate")).agg(F.count("*").alias("n")).withColumn("_k", clean_name(F.col("candidate"))).where("_k <> ''")
    best = counted.groupBy("_k").agg(F.max_by("candidate", F.struct("n", "candidate")).alias("normalized"))
    return counted.join(best, "_k").where("candidate <> normalized").select("candidate", "normalized")


def apply_names(mentions: DataFrame, mapping: DataFrame, item: str = "item") -> DataFrame:
    """``mentions`` with mapped items replaced; the mapping is a table (candidate, normalized). A candidate with two names is an error."""
    m = mapping.select(F.col("candidate").alias("_c"), F.col("normalized").alias("_n")).distinct()
    if (twice := m.groupBy("_c").agg(F.count("*").alias("_k")).where("_k > 1").first()) is not None:
        raise ValueError(f"the mapping has two names for {twice['_c']!r}")
    m = broadcast_if_small(m)
    return mentions.join(m, F.col(item) == F.col("_c"), "left").withColumn(item, F.coalesce("_n", item)).drop("_c", "_n")
