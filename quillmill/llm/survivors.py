"""The best representative of each group of duplicates (problem 1): votes over unpivoted fields.

Records of a group are unpivoted to long rows (group, field, value). A value that is part of another member's value is
not sound and cannot win. Each record with a sound value votes for it with its source's trust times the recency decay of the
record; votes are summed per normalised value, winners are chosen by ``max_by``, and the records are pivoted back to one row for each group.

Trust is ``2 ** -rank`` and decay lies in [0.75, 1], so a vote orders records by rank first and time second. Where agreement
counts, votes are summed as they are. Where a rule asks for the single best record, the best vote of a group's field counts
whole and every other one is divided by twice their number, so that all others together never outweigh it: the sum then gives the rule.

A group may hold a third of all rows. Everything is aggregated with map-side combining and equal values are merged first. The
search for beginnings of other values sorts all values by ranges, not by groups; only the ends of ranges, two rows each,
meet in one task. What a large group shares is sent to its rows by broadcast, of a thousand groups at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import clean
from quillmill.operators.packed import PACKINGS, values_of
from quillmill.plans import broadcast_if_small, looked_up, written

# Remarks that there is no abstract, letters only.
NO_ABSTRACT = ("noabstract", "abstractnotavailable", "noabstractavailable", "abstractunavailable", "noabstractprovided", "abstractnotprovided", "noabstractsupplied", "withoutabstract", "nosummary", "nosummaryavailable")

#: Rank of a source that is null or not listed: after any listed one.
LAST_RANK = 60

#: Half-life of a vote in days.
HALF_LIFE_DAYS = 365.0

GROUP_FIELDS = ["group_id", "field_name"]

FIELDS = ("abstract", "references", "doi")


def newest_time(records: DataFrame):
    """The latest time of ``records``, from which votes decay; one narrow scan, one value."""
    return records.agg(F.max("updated_at")).first()[0]


def vote(rank: Column, updated: Column, newest: Column) -> Column:
    """Trust times recency decay; the decay of a record without a time is the least."""
    age = F.greatest(F.lit(0), F.datediff(newest.cast("date"), updated.cast("date"))).cast("double")
    decay = F.when(updated.isNotNull() & newest.isNotNull(), 0.75 + 0.25 * F.pow(F.lit(2.0), -age / HALF_LIFE_DAYS)).otherwise(F.lit(0.75))
    return F.pow(F.lit(2.0), -rank.cast("double")) * decay


def cut_marks_off(c: Column) -> Column:
    """An abstract without the dots and brackets that mark a cut at its end."""
    return F.regexp_replace(clean.squeezed(c), "[\\s.…\\[\\](){}]+$", "")


def members(groups: DataFrame, records: DataFrame, sources: DataFrame, extra: list[str]) -> DataFrame:
    """(group_id, record_id, _rank, updated_at, the fields): each record of each group once.

    The pairs of group and record, two numbers a row, are broadcast if counted to be few; so are the few sources.
    """
    pairs = groups.select("group_id", "record_id").where("group_id is not null and record_id is not null").distinct()
    ranks = sources.select(F.lower(clean.squeezed(F.col("label"))).alias("_label"), "trust_rank").groupBy("_label").agg(F.min("trust_rank").alias("_rank"))
    rows = records.select("record_id", F.lower(clean.squeezed(F.col("source"))).alias("_label"), F.col("updated_at"), *(F.col(f"`{f}`") for f in extra))
    return rows.join(broadcast_if_small(pairs), "record_id").join(broadcast_if_small(ranks), "_label", "left").withColumn("_rank", F.coalesce("_rank", F.lit(LAST_RANK)))


def long_rows(found: DataFrame) -> DataFrame:
    """(group_id, field_name, record_id, norm, _h, _g, _rank, updated_at) of the values that can be sound.

    norm is what makes values equal: a DOI in small letters, an abstract without marks of a cut, references as a sorted set, one in
    a line; _h and _g are two hashes of it.
    """
    abstract = F.col("abstract")
    letters = F.regexp_replace(F.lower(abstract), "[^a-z]+", "")
    sound_abstract = F.when(~clean.is_missing(abstract) & ~((F.length(abstract) < 60) & letters.isin(*NO_ABSTRACT)), cut_marks_off(abstract))
    refs = F.array_join(F.array_sort(F.array_distinct(values_of(F.col("references"), PACKINGS["references"]))), "\n")
    doi = F.when(~clean.is_missing(F.col("doi")), clean.bare_doi(F.col("doi")))
    fields = F.array(*(F.struct(F.lit(f).alias("field_name"), c.alias("norm")) for f, c in zip(FIELDS, (sound_abstract, refs, doi), strict=True)))
    rows = found.select("group_id", "record_id", "updated_at", "_rank", F.inline(fields)).where("norm <> ''")
    return rows.withColumns({"_h": F.xxhash64("norm"), "_g": F.xxhash64(F.lit("second"), "norm")})


def merged(rows: DataFrame) -> DataFrame:
    """One row for each distinct value of a group's field: the key of its best record, and its number of votes as _n.

    Keys are greater for better records: by rank, then the latest time (null is less than any), then the smallest record_id.
    """
    key = F.struct((-F.col("_rank")).alias("_trust"), F.col("updated_at").alias("_at"), (-F.col("record_id")).alias("_neg"))
    return rows.groupBy(*GROUP_FIELDS, "norm", "_h", "_g").agg(F.max(key).alias("_key"), F.count("*").alias("_n"))


def begins_another(values: DataFrame) -> DataFrame:
    """``values`` without norm, with ``_part``: whether the norm is a proper beginning of another norm of the same group and field.

    In order, whatever begins with a text follows it at once, so the next distinct value decides. Values are sorted by ranges;
    the next value of the last one of a range is the first one of the next range that is not empty.
    """
    order = [*GROUP_FIELDS, "norm"]
    w = Window.partitionBy("_range").orderBy(*order)
    at = F.struct(*order)
    begun = lambda n: (n["group_id"] == F.col("group_id")) & (n["field_name"] == F.col("field_name")) & n["norm"].startswith(F.col("norm"))
    ranges = values.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    marked = ranges.withColumns({"_next": F.lead(at).over(w), "_first": F.row_number().over(w) == 1})
    edge = F.col("_first") | F.col("_next").isNull()
    kept = [c for c in values.columns if c != "norm"]
    found = written(marked.select(*kept, F.coalesce(begun(F.col("_next")), F.lit(False)).alias("_part"), F.when(edge, F.col("norm")).alias("norm")), "beginnings")
    ends = found.where("norm is not null").withColumn("_next", F.lead(at).over(Window.orderBy(*order)))  # two rows for each range
    across = ends.where(begun(F.col("_next"))).select(*GROUP_FIELDS, "norm", F.lit(True).alias("_more"))
    return found.join(broadcast_if_small(across), order, "left").withColumn("_part", F.col("_part") | F.coalesce("_more", F.lit(False))).drop("_more", "norm")


def within_another(values: DataFrame) -> DataFrame:
    """``values`` without norm, with ``_part``: whether its set, the lines of norm, is a proper subset of another set of the same group.

    The largest set of a group decides most cases. The sets that are left are looked up by their rarest part only, so
    members that share common parts are not paired.
    """
    kept = [c for c in values.columns if c != "norm"]
    sets = values.withColumn("parts", F.split("norm", "\n")).withColumn("_size", F.size("parts"))
    largest = sets.groupBy("group_id").agg(F.max_by("parts", F.struct("_size", "norm")).alias("_top"), F.count("*").alias("_rows"))
    tried = looked_up(sets, largest, ["group_id"], "_rows", few=2_000).withColumn("_in", (F.size("_top") > F.col("_size")) & (F.size(F.array_except("parts", "_top")) == 0)).withColumn("_is_top", F.col("parts") == F.col("_top"))
    tried = written(tried.select(*kept, "_size", "_in", F.when(~F.col("_in") & ~F.col("_is_top"), F.col("parts")).alias("parts")), "sets")
    id_ = ["group_id", "_h", "_g"]
    rest = tried.where("parts is not null").select(*id_, "_size", "parts")
    listed = rest.select(*id_, "_size", F.explode("parts").alias("_p"))
    rare = listed.groupBy("group_id", "_p").agg(F.count("*").alias("_c")).where("_c > 1")
    # parts that stand in one set only show that it is no subset
    probe = (
        looked_up(listed, rare, ["group_id", "_p"], "_c", keep="_c").groupBy(*id_)
        .agg(F.min(F.struct(F.coalesce("_c", F.lit(1)).alias("_c"), "_p")).alias("_r"), F.first("_size").alias("_s")).where("_r._c > 1").select("group_id", F.col("_h").alias("_hs"), F.col("_g").alias("_gs"), "_s", F.col("_r._p").alias("_p"))
    )
    met = probe.join(listed, ["group_id", "_p"]).where("_size > _s").select("group_id", "_hs", "_gs", "_h", "_g")
    small = rest.select("group_id", F.col("_h").alias("_hs"), F.col("_g").alias("_gs"), F.col("parts").alias("_small"))
    inside = met.join(rest.select(*id_, "parts"), id_).join(small, ["group_id", "_hs", "_gs"]).where(F.size(F.array_except("_small", "parts")) == 0)
    inside = inside.select("group_id", F.col("_hs").alias("_h"), F.col("_gs").alias("_g")).distinct().withColumn("_more", F.lit(True))
    return tried.join(inside, id_, "left").withColumn("_part", F.col("_in") | F.coalesce("_more", F.lit(False))).select(*kept, "_part")


def winners(groups: DataFrame, records: DataFrame, sources: DataFrame, agreement: bool) -> DataFrame:
    """(group_id, abstract, references, doi): the best record of the winning value of each field, null where none is sound.

    Rows and merged values are written once: searches and votes read them instead of the records.
    """
    rows = written(long_rows(members(groups, records, sources, list(FIELDS))), "rows")
    values = written(merged(rows), "values")
    sound = begins_another(values.where("field_name <> 'references'")).unionByName(within_another(values.where("field_name = 'references'"))).where("not _part").drop("_part")
    sound = written(sound, "sound")
    best = sound.groupBy(*GROUP_FIELDS).agg(F.max("_key").alias("_top"), F.sum("_n").alias("_all"))
    ballots = rows.select(*GROUP_FIELDS, "_h", "_g", "record_id", vote(F.col("_rank"), F.col("updated_at"), F.lit(newest_time(records))).alias("_v"))
    if not agreement:
        known = looked_up(ballots, best, GROUP_FIELDS, "_all", keep="_all")
        # ballots of values that are not sound are counted too, but no such value is left to win
        ballots = known.withColumn("_v", F.when(F.col("record_id") == -F.col("_top._neg"), F.col("_v")).otherwise(F.col("_v") / (2.0 * (F.col("_all") + 1))))
    # the last digits of a sum depend on its order and decide nothing
    summed = ballots.groupBy(*GROUP_FIELDS, "_h", "_g").agg(F.sum("_v").alias("_votes")).withColumn("_votes", F.round(F.log2("_votes"), 9))
    won = sound.join(summed, [*GROUP_FIELDS, "_h", "_g"]).groupBy(*GROUP_FIELDS).agg(F.max_by("_key", F.struct("_votes", "_key")).alias("_w"))
    return won.groupBy("group_id").pivot("field_name", list(FIELDS)).agg(F.max(-F.col("_w._neg")))


def best_records(groups: DataFrame, records: DataFrame, sources: DataFrame, agreement: bool = False) -> DataFrame:
    """(group_id, field_name, record_id): the record whose value of the field survives.

    Without ``agreement`` trust decides, then time, then the smallest record_id. Defined results: a value is sound if it is not
    missing, not a remark that there is none, not malformed, and no part of another member's value; a field without a sound value
    gives no row. Null times rank last, null and unlisted sources too. Repeated rows of ``groups`` count once; members that are not in
    ``records`` are ignored; empty tables give an empty table; other columns are not read.
    """
    wide = winners(groups, records, sources, agreement)
    fields = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").alias("record_id")) for f in FIELDS))
    return wide.select("group_id", F.inline(fields)).where("record_id is not null")


def survivors(groups: DataFrame, records: DataFrame, sources: DataFrame, agreement: bool = True) -> DataFrame:
    """(group_id, abstract, references, doi, source): one built record for each group; null where no value is sound.

    With ``agreement`` every vote counts whole, so several records may outvote one of a better source. source is the label of the most
    voted source of the group's members, in small letters. Defined results otherwise as in :func:`best_records`.
    """
    won = best_records(groups, records, sources, agreement)
    held = records.select("record_id", *(F.col(f"`{f}`") for f in FIELDS)).join(won, "record_id")
    value = F.coalesce(*(F.when(F.col("field_name") == f, F.col(f"`{f}`")) for f in FIELDS))
    wide = held.groupBy("group_id").agg(*(F.max(F.when(F.col("field_name") == f, value)).alias(f) for f in FIELDS))
    found = members(groups, records, sources, [])
    votes = found.where("_label <> ''").groupBy("group_id", "_label").agg(F.sum(F.pow(F.lit(2.0), -F.col("_rank").cast("double"))).alias("_v"))
    source = votes.groupBy("group_id").agg(F.max_by("_label", F.struct("_v", "_label")).alias("source"))
    return found.select("group_id").distinct().join(wide, "group_id", "left").join(source, "group_id", "left")
