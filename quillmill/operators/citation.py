"""References and citations over time: trajectories, spectroscopy, beauties, diversity, disruption."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.plans import checkpointed, joined_in_parts, row_count_at_most, split_join, written

#: Short titles that are tried on every reference.
FEW_TITLES = 2_000

#: Arcs of the longest chain of citations that is followed; beyond it there is an error.
LONGEST_CHAIN = 10_000


def top_references(references: DataFrame, n: int) -> DataFrame:
    """(ref, n): the most cited references."""
    return references.groupBy("ref").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "ref").limit(n)


def reference_year(text: Column, last_year: int, first_year: int = 1665) -> Column:
    """The greatest number of four digits in [first_year, last_year] that stands alone in ``text``, else -1."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{4})(?!\d)"), 1), lambda y: y.cast("int"))
    return F.coalesce(F.array_max(F.filter(years, lambda y: y.between(first_year, last_year))), F.lit(-1))


def trajectory(references: DataFrame, papers: DataFrame, refs: list[str]) -> DataFrame:
    """(ref, year, n, total): citations of chosen references in each year, years without any too."""
    hits = references.where(F.col("ref").isin(refs)).join(papers.select("doc_id", "year"), "doc_id").groupBy("ref", "year").agg(F.count("*").alias("n"))
    span = papers.agg(F.sequence(F.min("year"), F.max("year")).alias("_y")).select(F.explode("_y").alias("year"))
    names = hits.select("ref").distinct()
    full = names.crossJoin(F.broadcast(span)).join(hits, ["ref", "year"], "left").withColumn("n", F.coalesce("n", F.lit(0)))  # names x years
    return full.withColumn("total", F.sum("n").over(Window.partitionBy("ref").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))


def spectroscopy(years: DataFrame) -> DataFrame:
    """(year, n, deviation): references of each reference year, and the distance from the median of five years around.

    ``years`` is (ref, year) of distinct references; unknown years (-1) are dropped.
    """
    counts = years.where("year >= 0").groupBy("year").agg(F.count("*").alias("n"))
    around = F.sort_array(F.collect_list("n").over(Window.orderBy("year").rangeBetween(-2, 2)))  # as many rows as years
    m = F.size(around)
    median = (F.element_at(around, F.floor((m + 1) / 2).cast("int")) + F.element_at(around, F.floor(m / 2 + 1).cast("int"))) / 2.0
    return counts.select("year", "n", (F.col("n") - median).alias("deviation"))


def smoothed(counts: DataFrame, sigma: float = 1.0, radius: int = 4) -> DataFrame:
    """(year, n, smooth, peak): a Gaussian over the existing years with reflected edges, cut to whole numbers.

    The literal rule: years without references are not filled in, and smoothed values lose their fractions.
    """
    size = counts.agg(F.count("*").alias("_m"))
    numbered = counts.withColumn("_k", F.row_number().over(Window.orderBy("year")) - 1)  # as many rows as years
    shift = F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("_d")
    moved = numbered.crossJoin(F.broadcast(size)).select("year", "n", "_k", "_m", shift)
    at = F.pmod(F.col("_k") + F.col("_d"), 2 * F.col("_m"))
    moved = moved.withColumn("_at", F.when(at < F.col("_m"), at).otherwise(2 * F.col("_m") - 1 - at)).withColumn("_w", F.exp(-F.col("_d") * F.col("_d") / (2 * sigma * sigma)))
    near = numbered.select(F.col("_k").alias("_at"), F.col("n").alias("_v"))
    smooth = moved.join(F.broadcast(near), "_at").groupBy("year", "n").agg(F.floor(F.sum(F.col("_w") * F.col("_v")) / F.sum("_w") + 1e-9).alias("smooth"))
    w = Window.orderBy("year")
    peak = (F.col("smooth") > F.lag("smooth", 1).over(w)) & (F.col("smooth") > F.lead("smooth", 1).over(w)) & (F.col("smooth") >= 1)
    return smooth.withColumn("peak", F.coalesce(peak, F.lit(False)))


def local_citations(references: DataFrame, papers: DataFrame, strict: bool = True) -> DataFrame:
    """(src, dst, src_year, dst_year): references matched to papers of the corpus, citing later than cited."""
    pairs = references.select(F.col("doc_id").alias("src"), F.col("ref_doc").alias("dst")).where("src <> dst").distinct()
    years = papers.select("doc_id", "year")
    both = pairs.join(years.toDF("dst", "dst_year"), "dst").join(years.toDF("src", "src_year"), "src")
    return both.where("src_year > dst_year" if strict else "src_year >= dst_year").select("src", "dst", "src_year", "dst_year")


def historiograph(cites: DataFrame) -> DataFrame:
    """(doc_id, n_cited, n_citing): how often a paper is cited within the corpus, and how many of it it cites."""
    ends = cites.select(F.col("dst").alias("doc_id"), F.lit(1).alias("_in"), F.lit(0).alias("_out")).unionAll(cites.select("src", F.lit(0), F.lit(1)))
    return ends.groupBy("doc_id").agg(F.sum("_in").alias("n_cited"), F.sum("_out").alias("n_citing"))


def sleeping_beauties(references: DataFrame, papers: DataFrame, least: int = 1) -> DataFrame:
    """(ref, b, sbi, awakening, c0, cm, tm, total) of references with a positive beauty coefficient.

    Years count from the first year of the corpus for every reference (the literal rule).
    """
    base = papers.where("year > 0").agg(F.min("year").alias("_y0"), F.max("year").alias("_y1"))
    by_year = references.join(papers.where("year > 0").select("doc_id", "year"), "doc_id").groupBy("ref", "year").agg(F.count("*").alias("n"))
    series = by_year.groupBy("ref").agg(F.map_from_entries(F.collect_list(F.struct("year", "n"))).alias("_m"), F.sum("n").alias("total")).where(F.col("total") >= least)
    c = F.transform(F.sequence("_y0", "_y1"), lambda y: F.coalesce(F.element_at("_m", y), F.lit(0)).cast("double"))
    rows = series.crossJoin(F.broadcast(base)).select("ref", "total", c.alias("_c"))
    rows = rows.withColumn("cm", F.array_max("_c")).withColumn("tm", (F.array_position("_c", F.col("cm")) - 1).cast("int")).withColumn("c0", F.element_at("_c", 1)).where("tm > 0")
    slope = (F.col("cm") - F.col("c0")) / F.col("tm")
    until = F.slice("_c", F.lit(1), F.col("tm") + 1)
    b = F.aggregate(F.transform(until, lambda x, t: (slope * t + F.col("c0") - x) / F.greatest(F.lit(1.0), x)), F.lit(0.0), lambda a, x: a + x)
    norm = F.greatest(F.col("tm").cast("double"), F.lit(1.0))
    length = F.sqrt((F.col("cm") - F.col("c0")) * (F.col("cm") - F.col("c0")) + norm * norm)
    far = F.transform(until, lambda x, t: F.round(F.abs((F.col("cm") - F.col("c0")) * t - F.col("tm") * x + F.col("tm") * F.col("c0")) / length, 9))
    rows = rows.withColumn("b", b).withColumn("sbi", F.col("b") / length).withColumn("awakening", (F.array_position(far, F.array_max(far)) - 1).cast("int"))
    return rows.where("b > 0").select("ref", F.round("b", 6).alias("b"), F.round("sbi", 6).alias("sbi"), "awakening", F.col("c0").cast("int").alias("c0"), F.col("cm").cast("int").alias("cm"), "tm", "total")


def princes(cites: DataFrame, beauties: DataFrame) -> DataFrame:
    """(beauty, prince, n): the citer of a beauty that its other citers cite most; ties to the smallest id. ``beauties``: (beauty)."""
    citers = cites.join(beauties.select(F.col("beauty").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("beauty"), F.col("src").alias("citer"))
    inner = cites.select(F.col("src").alias("citer"), F.col("dst").alias("prince"))
    counted = citers.join(inner, "citer").join(citers.select("beauty", F.col("citer").alias("prince")), ["beauty", "prince"], "left_semi").groupBy("beauty", "prince").agg(F.count("*").alias("n"))
    best = counted.groupBy("beauty").agg(F.max(F.struct("n", (-F.col("prince")).alias("_neg"))).alias("_b"))
    return best.select("beauty", (-F.col("_b._neg")).alias("prince"), F.col("_b.n").alias("n"))


def reference_diversity(cites: DataFrame, papers: DataFrame, source: str = "journal") -> DataFrame:
    """(doc_id, n_refs, mean_age, std_age, entropy, evenness): the references of each paper within the corpus."""
    rows = cites.join(papers.select(F.col("doc_id").alias("dst"), F.col(source).alias("_s")), "dst")
    ages = rows.groupBy("src").agg(F.count("*").alias("n_refs"), F.avg(F.col("src_year") - F.col("dst_year")).alias("mean_age"), F.stddev_pop(F.col("src_year") - F.col("dst_year")).alias("std_age"))
    shares = rows.groupBy("src", "_s").agg(F.count("*").alias("_n"))
    totals = shares.groupBy("src").agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"), F.sum(F.col("_n") * F.ln(F.col("_n").cast("double"))).alias("_x"))
    entropy = F.ln(F.col("_t").cast("double")) - F.col("_x") / F.col("_t")
    out = ages.join(totals, "src").withColumn("entropy", F.greatest(F.lit(0.0), entropy))
    return out.select(F.col("src").alias("doc_id"), "n_refs", F.round("mean_age", 6).alias("mean_age"), F.round("std_age", 6).alias("std_age"), F.round("entropy", 6).alias("entropy"), F.round(F.when(F.col("_k") > 1, F.col("entropy") / F.ln(F.col("_k").cast("double"))).otherwise(0.0), 6).alias("evenness"))


def disruption(cites: DataFrame, least_citers: int = 1, strict_future: bool = True) -> DataFrame:
    """(doc_id, ni, nj, nk, di): later papers citing the focal paper only, both it and its references, or its references only.

    ``strict_future`` false also takes papers of the focal paper's own year. A reference that very many papers cite meets its citers
    block by block.
    """
    links = checkpointed(cites.select("src", "dst", "src_year", "dst_year"))
    citers = links.select(F.col("dst").alias("focal"), F.col("src").alias("citer"))
    refs = links.select(F.col("src").alias("focal"), F.col("dst").alias("ref"), F.col("src_year").alias("focal_year"))
    other = links.select(F.col("src").alias("citer"), F.col("dst").alias("ref"), F.col("src_year").alias("citer_year"))
    later = "citer_year > focal_year" if strict_future else "citer_year >= focal_year"
    of_refs = split_join(refs, other, ["ref"]).where(f"{later} and citer <> focal").select("focal", "citer").distinct()
    marked = citers.withColumn("_f", F.lit(1)).join(of_refs.withColumn("_r", F.lit(1)), ["focal", "citer"], "full")
    both = F.col("_f").isNotNull() & F.col("_r").isNotNull()
    counted = marked.groupBy("focal").agg(F.count_if(F.col("_r").isNull()).alias("ni"), F.count_if(both).alias("nj"), F.count_if(F.col("_f").isNull()).alias("nk"))
    known = counted.join(refs.select("focal").distinct(), "focal", "left_semi").where(F.col("ni") + F.col("nj") >= least_citers)
    return known.select(F.col("focal").alias("doc_id"), "ni", "nj", "nk", F.round((F.col("ni") - F.col("nj")) / (F.col("ni") + F.col("nj") + F.col("nk")), 6).alias("di"))


def own_name_citations(authors: DataFrame, references: DataFrame) -> DataFrame:
    """(item, n_self): references of an entity's own papers whose text holds its name. Tables (doc_id, item), (doc_id, ref)."""
    rows = authors.select("doc_id", "item").distinct().join(references.select("doc_id", "ref"), "doc_id")
    return rows.where(F.lower("ref").contains(F.lower("item"))).groupBy("item").agg(F.count("*").alias("n_self"))


def citing_papers(references: DataFrame, papers: DataFrame, years: tuple[int | None, int | None] = (None, None), refs: list[str] | None = None) -> DataFrame:
    """(ref, doc_id, year): which papers cite each reference, each once, in a span of years and for chosen references."""
    kept = papers.where("year is not null").select("doc_id", "year")
    for limit, at_least in zip(years, (True, False), strict=True):
        if limit is not None:
            kept = kept.where(F.col("year") >= limit if at_least else F.col("year") <= limit)
    rows = references.where("ref is not null and lower(ref) <> 'unknown'")
    rows = rows.where(F.col("ref").isin(refs)) if refs else rows
    return rows.select("doc_id", "ref").distinct().join(kept, "doc_id").select("ref", "doc_id", "year")


def co_cited_groups(references: DataFrame, size: int, top: int, least: int = 1) -> DataFrame:
    """(refs, n): the sets of ``size`` references that most papers cite together, as sorted texts between bars.

    A set stands in no more papers than its rarest member, so references of fewer than ``least`` papers are dropped first. Sets are
    made member by member with generators, so those of one paper never stand in memory together.
    """
    once = references.where("ref is not null").select("doc_id", "ref").distinct()
    if least > 1:
        once = once.join(once.groupBy("ref").agg(F.count("*").alias("_c")).where(F.col("_c") >= least).select("ref"), "ref", "left_semi")
    lists = once.groupBy("doc_id").agg(F.array_sort(F.collect_list("ref")).alias("_r")).where(F.size("_r") >= size)
    sets = lists.select(F.array().cast("array<string>").alias("_s"), "_r")
    for k in range(size):
        step = sets.select("_s", "_r", F.posexplode("_r").alias("_k", "_x"))
        rest = F.slice("_r", F.col("_k") + 2, F.size("_r"))
        sets = step.select(F.concat("_s", F.array("_x")).alias("_s"), rest.alias("_r")).where(F.size("_r") >= size - k - 1)
    counted = sets.select(F.array_join("_s", "|").alias("refs")).groupBy("refs").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counted.orderBy(F.col("n").desc(), "refs").limit(top)


def _titles(papers: DataFrame) -> DataFrame:
    """(target, _title): the titles that can be looked for, in small letters."""
    return papers.where("title is not null and trim(title) <> '' and lower(trim(title)) <> 'unknown'").select(F.col("doc_id").alias("target"), F.lower("title").alias("_title"))


def _holding(references: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, ref, _title, ...): references whose text in small letters holds a title; ``titles`` has one row for each ``_title``.

    A title is looked up by the rarest of its inner words, which stand in the reference as whole words, and only if the references
    have all of them; references meet titles by words that are looked for, never by all their words. Titles of one or two
    words are tried one by one where they are few, else compared with the pieces of references as long as they, in the task that made these.
    """
    texts = written(references.where("ref is not null").select("doc_id", "ref"), "texts")  # read three times
    words = lambda c: F.regexp_extract_all(c, F.lit("[\\p{L}\\p{N}]+"), 0)
    split = written(titles.withColumns({"_w": words(F.col("_title")), "_id": F.monotonically_increasing_id()}), "titles")
    each = F.explode(F.array_distinct(words(F.lower("ref")))).alias("_k")
    rare = texts.select(each).groupBy("_k").agg(F.count("*").alias("_c"))
    inner = split.where(F.size("_w") > 2).select("_id", F.array_distinct(F.slice("_w", F.lit(2), F.size("_w") - 2)).alias("_i"))
    met = inner.select("_id", F.size("_i").alias("_s"), F.explode("_i").alias("_k")).join(rare, "_k")
    keys = met.groupBy("_id", "_s").agg(F.min(F.struct("_c", "_k")).alias("_m"), F.count("*").alias("_n")).where("_n = _s").select("_id", F.col("_m._k").alias("_k"))
    probes = written(split.drop("_w").join(keys, "_id").drop("_id"), "probes")
    held = written(joined_in_parts(texts.select("doc_id", "ref", each), probes.select("_k").distinct(), "_k"), "held")
    long = split_join(held, probes, ["_k"]).where(F.lower("ref").contains(F.col("_title"))).drop("_k")
    short = split.where(F.size("_w") <= 2).drop("_w", "_id")
    out = ["doc_id", "ref", *titles.columns]
    if row_count_at_most(short, FEW_TITLES):
        all_ = short.agg(F.collect_list(F.struct(*titles.columns)).alias("_s"))
        hit = texts.crossJoin(F.broadcast(all_)).withColumn("_t", F.lower("ref"))  # one row
        hit = hit.select("doc_id", "ref", F.inline(F.filter("_s", lambda x: F.col("_t").contains(x["_title"]))))
    else:
        lengths = [r[0] for r in short.select(F.length("_title")).distinct().collect()]  # lengths of titles of one or two words
        low = F.lower("ref")
        pieces = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - n + 1)), lambda i: F.substring(low, i, F.lit(n)))
        cut = [texts.select("doc_id", "ref", F.explode(F.array_distinct(pieces(n))).alias("_title")) for n in lengths]
        hit = reduce(DataFrame.unionByName, (joined_in_parts(c, short.where(F.length("_title") == n), "_title") for c, n in zip(cut, lengths, strict=True)))
    return long.select(out).unionByName(hit.select(out))


def named_titles(references: DataFrame, papers: DataFrame) -> DataFrame:
    """(doc_id, ref, target): references whose text holds the title of a paper, both in small letters.

    ``papers`` is (doc_id, title). Each title is looked for once, however many papers have it; see :func:`named_title_counts` for numbers
    where titles such as years stand in very many references.
    """
    titles = _titles(papers).distinct()
    held = _holding(references, titles.select("_title").distinct())
    return split_join(written(held, "hits"), written(titles, "targets"), ["_title"]).select("doc_id", "ref", "target").distinct()


def named_title_counts(references: DataFrame, papers: DataFrame) -> DataFrame:
    """(doc_id, n): how many rows :func:`named_titles` has for each paper, counted without listing the papers of each title."""
    titles = _titles(papers).where("target is not null").distinct()
    twice = titles.groupBy("target").agg(F.min(F.xxhash64("_title")).alias("_a"), F.max(F.xxhash64("_title")).alias("_b")).where("_a <> _b").select("target")
    some = not twice.isEmpty()  # papers that have several titles, of which a reference may hold more than one
    own = titles.join(twice, "target", "left_anti") if some else titles
    found = _holding(references, own.groupBy("_title").agg(F.count("*").alias("n"))).distinct().groupBy("doc_id").agg(F.sum("n").alias("n"))
    if some:
        kept = titles.join(twice, "target", "left_semi").select(F.col("target").alias("doc_id"), F.col("_title").alias("title"))
        listed = named_titles(references, kept).groupBy("doc_id").agg(F.count("*").alias("n"))
        found = found.unionByName(listed).groupBy("doc_id").agg(F.sum("n").alias("n"))
    return found


def past_citations(named: DataFrame, papers: DataFrame) -> DataFrame:
    """(year, n): how often papers of a year cite papers of the corpus, out of :func:`named_titles` or its counts; years without any have 0."""
    years = papers.where("year is not null").select("doc_id", "year")
    each = F.sum("n") if "n" in named.columns else F.count("target")
    counted = named.join(years, "doc_id").groupBy("year").agg(each.alias("_n"))
    return years.select("year").distinct().join(counted, "year", "left").select("year", F.coalesce("_n", F.lit(0)).alias("n"))


def self_citation_rates(cites: DataFrame, authors: DataFrame) -> DataFrame:
    """(doc_id, n_refs, rate): the share of a paper's references within the corpus that share an author with it. ``authors``: (doc_id, item)."""
    once = authors.where("item is not null and upper(trim(item)) <> 'UNKNOWN'").select("doc_id", F.lower(F.trim("item")).alias("item")).distinct()
    links = cites.select("src", "dst").distinct()
    shared = links.join(once.toDF("src", "item"), "src").join(once.toDF("dst", "item"), ["dst", "item"], "left_semi").select("src", "dst").distinct().withColumn("_s", F.lit(1))
    return links.join(shared, ["src", "dst"], "left").groupBy(F.col("src").alias("doc_id")).agg(F.count("*").alias("n_refs"), F.round(F.avg(F.coalesce("_s", F.lit(0))), 6).alias("rate"))


def history_paths(cites: DataFrame, least: int = 2, most: int = LONGEST_CHAIN) -> DataFrame:
    """(source, target, n, path): a shortest chain of citations between each two papers that has one, those within another left out.

    n counts the papers of a chain, ``path`` names them between bars; of chains of the same length the smallest by ids counts. A chain is
    left out if all its papers stand in a longer one, or in an earlier one of the same length: both its ends do then, so chains meet
    through the pairs of their papers. Made for graphs in which few papers can be reached from one.
    """
    links = checkpointed(cites.select("src", "dst").distinct().repartition("src"))
    level = checkpointed(links.select(F.col("src").alias("s"), F.col("dst").alias("t"), F.array("src", "dst").alias("p")))
    found = level
    for _ in range(most):
        longer = level.join(links.toDF("t", "_n"), "t").select("s", F.col("_n").alias("t"), F.concat("p", F.array("_n")).alias("p")).where("s <> t")
        new = longer.groupBy("s", "t").agg(F.min("p").alias("p")).join(found.select("s", "t"), ["s", "t"], "left_anti")
        level = checkpointed(new.select("s", "t", "p"))
        if level.isEmpty():
            break
        found = checkpointed(found.unionByName(level))
    else:
        raise ValueError(f"chains of more than {most} arcs")
    kept = found.where(F.size("p") >= least)
    ends = kept.where(F.size("p") > 2).select(F.col("p").alias("_q"), F.posexplode("p").alias("_i", "s")).select("_q", "s", F.explode(F.slice("_q", F.col("_i") + 2, F.size("_q"))).alias("t"))
    before = (F.size("_q") > F.size("p")) | ((F.size("_q") == F.size("p")) & (F.col("_q") < F.col("p")))
    within = kept.join(ends, ["s", "t"]).where(before & (F.size(F.array_except("p", "_q")) == 0)).select("s", "t").distinct()
    return kept.join(within, ["s", "t"], "left_anti").select(F.col("s").alias("source"), F.col("t").alias("target"), F.size("p").alias("n"), F.array_join(F.transform("p", lambda x: x.cast("string")), "|").alias("path"))


def history_ends(cites: DataFrame) -> DataFrame:
    """(kind, doc_id, n): the most cited and the most citing papers of the corpus, ties all."""
    both = historiograph(cites).select("doc_id", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("n")) for k, c in (("cited", "n_cited"), ("citing", "n_citing"))))))
    return both.join(F.broadcast(both.groupBy("kind").agg(F.max("n").alias("n")).where("n > 0")), ["kind", "n"]).select("kind", "doc_id", "n")  # two rows
