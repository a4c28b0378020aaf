"""Nested works as flat tables (problem 6): flattening Arrow buffers by list offsets and parent indices.

The JSON text is parsed on the JVM side into arrays and maps, with text in every place where deliveries differ in type. The
nested columns then reach Python as Arrow buffers, and no row is parsed there: the offsets of a list give each
child its parent, the child's position is its place minus its parent's offset, and keys are propagated by a
vectorised take. Works delivered again are dropped at the end by their rows, combined on the map side, so that one work
delivered very often does not gather in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import clean

PLAIN = ("id", "display_name", "publication_year", "type", "language", "cited_by_count", "doi", "referenced_works", "abstract_inverted_index")

#: What the flat tables are made of.
CHILDREN = ("id", "referenced_works", "abstract_inverted_index")


def _schema(fields: tuple[str, ...]) -> tuple[str, str]:
    """The types of a work and of a payload, with text for every field."""
    work = ", ".join(f"{f}:string" for f in fields)
    return f"struct<{work}>", f"array<struct<{work}, results:array<struct<{work}>>>>"


OPTIONS = {"allowSingleQuotes": "false", "allowNumericLeadingZeros": "false", "mode": "PERMISSIVE"}


def work_id(c: Column) -> Column:
    """``W`` and digits out of any way to write a work's id; null where there is none."""
    found = F.upper(F.regexp_extract(c, r"(?i)(?:^|[/:\s])(w\d+)/?\s*$", 1))
    return F.when(found != "", found)


def works_of(payloads: DataFrame, payload: str = "payload", fields: tuple[str, ...] = PLAIN, keep: Column | None = None) -> DataFrame:
    """One row for each work in a payload: a work, a list of works, or an object with ``results``; ``keep``, of the payload, stays as ``_kept``.

    A byte order mark and blanks around the payload are ignored. Payloads that are null or not valid JSON, and parts that
    are no work, give no row. The columns are texts, for deliveries differ in their types.
    """
    text = F.regexp_replace(F.col(payload), f"^{clean.BLANK}+|{clean.BLANK}+$", "")
    # within brackets, so that anything after the end of the value makes it invalid
    kept = [] if keep is None else [keep.alias("_kept")]
    wrapped = payloads.select(F.concat(F.lit("["), text, F.lit("]")).alias("_json"), *kept)
    listed = F.col("_json").startswith("[[")
    kind, objects = _schema(fields)
    one = F.from_json("_json", objects, OPTIONS)
    many = F.from_json("_json", f"array<{objects}>", OPTIONS)
    tops = F.when(listed, F.when(F.size(many) == 1, many[0])).otherwise(F.when(F.size(one) == 1, one))
    inner = lambda t: F.when(t["results"].isNotNull(), t["results"]).otherwise(F.array(F.struct(*(t[f].alias(f) for f in fields))))
    works = F.coalesce(F.flatten(F.transform(F.filter(tops, lambda t: t.isNotNull()), inner)), _piecewise(listed, kind))
    return wrapped.select(F.explode(works).alias("_work"), *(["_kept"] if kept else [])).where("_work is not null").select("_work.*", *(["_kept"] if kept else []))


def _piecewise(listed: Column, kind: str) -> Column:
    """The works of a payload whose parts differ in type, such as a list with numbers in it: part by part."""
    texts = F.from_json("_json", "array<string>", OPTIONS)
    texts = F.when(listed, F.when(F.size(texts) == 1, F.from_json(texts[0], "array<string>", OPTIONS))).otherwise(F.when(F.size(texts) == 1, texts))
    objects = lambda ts: F.filter(ts, lambda t: t.startswith("{"))
    results = F.transform(objects(texts), lambda t: F.coalesce(F.from_json(t, "struct<results:array<string>>", OPTIONS)["results"], F.array(t)))
    return F.transform(objects(F.flatten(results)), lambda t: F.from_json(t, kind, OPTIONS))


def references_of(c: Column) -> Column:
    """The list as it was delivered: a list, or one text with any delimiters."""
    return F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.filter(F.split(c, r"[;,|\s]+"), lambda x: x != ""))


def _children(lists: pa.ListArray, keys: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(parent's key, position, child) of every child; nothing is read row by row."""
    parent = pc.list_parent_indices(lists)
    child = pc.list_flatten(lists)
    first = pc.subtract(lists.offsets, lists.offsets[0]).cast(pa.int64())
    place = pa.array(np.arange(len(child)))
    return keys.take(parent), pc.subtract(place, first.take(parent)), child


FLAT = pa.schema([("work_id", pa.string()), ("child", pa.string()), ("pos", pa.int32()), ("item", pa.string())])


def _flat(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids = batch.column("work_id")
    refs = batch.column("refs")
    there = refs.is_valid()
    key, pos, item = _children(refs.filter(there), ids.filter(there))
    item = pc.replace_substring_regex(pc.utf8_upper(pc.utf8_trim_whitespace(item)), r"^(?:.*[/:\s])?(W\d+)/?$", r"\1")
    good = pc.fill_null(pc.match_substring_regex(item, r"^W\d+$"), False)
    yield _rows("referenced_works", key.filter(good), pos.filter(good), item.filter(good))

    index = batch.column("words")
    there = index.is_valid()
    index, ids = index.filter(there), ids.filter(there)
    words = pa.ListArray.from_arrays(index.offsets, pa.array(np.arange(len(index.keys), dtype=np.int32)))
    owner, _, slot = _children(words, ids)
    word, places = index.keys.take(slot), index.items.take(slot)
    there = places.is_valid()
    # the positions of a word come as the text of a list, in which numbers and texts may be mixed
    lists = pc.split_pattern(pc.replace_substring_regex(places.filter(there), r'[\[\]"\s]', ""), ",")
    parent = pc.list_parent_indices(lists)
    place = pc.list_flatten(lists)
    key, item = owner.filter(there).take(parent), word.filter(there).take(parent)
    good = pc.fill_null(pc.match_substring_regex(place, r"^\d{1,9}$"), False)
    pos = place.filter(good).cast(pa.int64())
    yield _rows("abstract_inverted_index", key.filter(good), pos, item.filter(good))


def _rows(child: str, key: pa.Array, pos: pa.Array, item: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key, pa.array([child]).take(pa.array(np.zeros(len(key), np.int32))), pos.cast(pa.int32()), item], schema=FLAT)


def flattened(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(work_id, child, pos, item): the referenced works and the words of the abstracts, each row once.

    pos is the place in the list, null entries counted but not shown, or the word's position in the abstract. Defined results: works
    without an id, parts that are absent, null or empty, and entries that are no id or no position give no row; a position outside a list counts as a list of one; works
    delivered again add only rows that differ; an empty table gives an empty table; other columns are not read.
    """
    works = works_of(payloads, payload, CHILDREN).select(work_id(F.col("id")).alias("work_id"), references_of(F.col("referenced_works")).alias("refs"), F.from_json("abstract_inverted_index", "map<string,string>", OPTIONS).alias("words"))
    nested = works.where("work_id is not null and (refs is not null or words is not null)")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield from _flat(batch)

    return nested.mapInArrow(run, "work_id string, child string, pos int, item string").distinct()


def works_table(payloads: DataFrame, payload: str = "payload", loaded: str = "loaded_at") -> DataFrame:
    """One row for each work_id with its plain fields as last delivered; the parent of :func:`flattened`.

    (work_id, doi, display_name, publication_year, type, language, cited_by_count): all of one delivery, the one with the latest
    ``loaded``, null or no such column before any; ties go to the delivery that is greatest field by field. Numbers that are not whole are null.
    """
    at = F.col(f"`{loaded}`") if loaded in payloads.columns else F.lit(None).cast("timestamp")
    number = lambda c, kind: F.col(c).try_cast("double").try_cast(kind).alias(c)
    works = works_of(payloads, payload, keep=at).select(
        work_id(F.col("id")).alias("work_id"), "_kept",
        F.struct("doi", "display_name", number("publication_year", "int"), "type", "language", number("cited_by_count", "bigint")).alias("_w"),
    )
    last = works.where("work_id is not null").groupBy("work_id").agg(F.max(F.struct("_kept", "_w")).alias("_l"))
    return last.select("work_id", "_l._w.*")


def openalex_references(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(citing_work_id, citing_title, cited_work_id, cited_title, inside): every reference of every work; titles of works that are not there are null."""
    titles = works_table(payloads, payload).select("work_id", "display_name")
    refs = flattened(payloads, payload).where("child = 'referenced_works'").select(F.col("work_id").alias("citing_work_id"), F.col("item").alias("cited_work_id")).distinct()
    named = refs.join(titles.toDF("citing_work_id", "citing_title"), "citing_work_id").join(titles.toDF("cited_work_id", "cited_title").withColumn("_in", F.lit(True)), "cited_work_id", "left")
    return named.select("citing_work_id", "citing_title", "cited_work_id", "cited_title", F.coalesce("_in", F.lit(False)).alias("inside"))


def openalex_edges(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(source_id, target_id, source_title, target_title): references between works that are both there; nodes are :func:`works_table`."""
    inside = openalex_references(payloads, payload).where("inside")
    return inside.select(F.col("citing_work_id").alias("source_id"), F.col("cited_work_id").alias("target_id"), F.col("citing_title").alias("source_title"), F.col("cited_title").alias("target_title"))
