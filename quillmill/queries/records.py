"""Queries on records as delivered: packed cells and nested works."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import nested, packed


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of the packed fields of papers."""
    return packed.unpacked(_table(spark, sf, "papers"), "record_id")


def p2_letters(spark: SparkSession, sf: str) -> DataFrame:
    """What p2_found keeps of each cell: its letters in order, as a hash, delimiters that are words aside."""
    values = packed.unpacked(_table(spark, sf, "papers"), "record_id")
    lists = values.groupBy("record_id", "field_name").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("_v"))
    text = F.array_join(F.transform("_v", lambda x: F.regexp_replace(x["item"], "[^\\p{L}]+", "")), "")
    return lists.select("record_id", "field_name", F.size("_v").alias("n"), F.md5(text).alias("letters")).where("letters is not null").drop("n")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Referenced works and abstract words of the delivered works."""
    return nested.flattened(_table(spark, sf, "works_raw"))


def p6_works(spark: SparkSession, sf: str) -> DataFrame:
    """The parent table of p6_found: one row for each work."""
    return nested.works_table(_table(spark, sf, "works_raw"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p2_letters": p2_letters, "p6_found": p6_found, "p6_works": p6_works}


#: The works of the payloads: a work, a list of works, or an object with results.
WORKS = """WITH t AS (SELECT loaded_at, regexp_replace(payload, '^[\\s\\x{00a0}\\x{200b}\\x{feff}]+|[\\s\\x{00a0}\\x{200b}\\x{feff}]+$', '', 'g') AS p FROM works_raw),
v AS (SELECT loaded_at, CAST(p AS JSON) AS j FROM t WHERE p <> '' AND json_valid(p)),
o AS (SELECT loaded_at, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN from_json(j, '["JSON"]') ELSE [j] END) AS j FROM v),
r AS (SELECT loaded_at, unnest(CASE WHEN json_type(j, '$.results') = 'ARRAY' THEN from_json(json_extract(j, '$.results'), '["JSON"]') ELSE [j] END) AS w FROM o WHERE json_type(j) = 'OBJECT'),
w AS (SELECT loaded_at, w, upper(regexp_extract(w ->> '$.id', '(?i)(?:^|[/:\\s])(w\\d+)/?\\s*$', 1)) AS work_id FROM r WHERE json_type(w) = 'OBJECT' AND regexp_matches(w ->> '$.id', '(?i)(?:^|[/:\\s])w\\d+/?\\s*$'))
"""

_FOUND = WORKS + """, l AS (SELECT work_id, json_type(w, '$.referenced_works') AS kind, json_extract(w, '$.referenced_works') AS a FROM w),
e AS (SELECT work_id, CASE kind WHEN 'ARRAY' THEN list_transform(from_json(a, '["JSON"]'), lambda x: x ->> '$') WHEN 'VARCHAR' THEN list_filter(regexp_split_to_array(a ->> '$', '[;,|\\s]+'), lambda x: x <> '') END AS items FROM l),
f AS (SELECT work_id, unnest(range(0, len(items))) AS pos, unnest(items) AS x FROM e),
i AS (SELECT work_id, unnest(json_keys(w, '$.abstract_inverted_index')) AS item, json_extract(w, '$.abstract_inverted_index') AS m FROM w WHERE json_type(w, '$.abstract_inverted_index') = 'OBJECT'),
k AS (SELECT i.work_id, i.item, unnest(regexp_split_to_array(regexp_replace(CAST(e.value AS VARCHAR), '[\\[\\]"\\s]', '', 'g'), ',')) AS p FROM i, json_each(i.m) e WHERE e.key = i.item)
SELECT DISTINCT work_id, 'referenced_works' AS child, CAST(pos AS INT) AS pos, upper(regexp_extract(trim(x), '(?i)^(?:.*[/:\\s])?(w\\d+)/?$', 1)) AS item FROM f WHERE regexp_matches(trim(x), '(?i)^(?:.*[/:\\s])?w\\d+/?$')
UNION ALL SELECT DISTINCT work_id, 'abstract_inverted_index', CAST(p AS INT), item FROM k WHERE regexp_matches(p, '^\\d{1,9}$')"""

_TABLE = WORKS + """, s AS (SELECT work_id, loaded_at, w ->> '$.doi' AS doi, w ->> '$.display_name' AS display_name, TRY_CAST(TRY_CAST(w ->> '$.publication_year' AS DOUBLE) AS INT) AS publication_year,
w ->> '$.type' AS type, w ->> '$.language' AS language, TRY_CAST(TRY_CAST(w ->> '$.cited_by_count' AS DOUBLE) AS BIGINT) AS cited_by_count FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY loaded_at DESC NULLS LAST, doi DESC NULLS LAST, display_name DESC NULLS LAST, publication_year DESC NULLS LAST, type DESC NULLS LAST, language DESC NULLS LAST, cited_by_count DESC NULLS LAST) AS n FROM s)
SELECT work_id, doi, display_name, publication_year, type, language, cited_by_count FROM n WHERE n = 1"""


_MISSING = "(coalesce(lower(trim(regexp_replace({c}, '[\\s\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200b}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+', ' ', 'g'))), '') IN ('', 'unknown', 'unkn', 'n/a', 'none', '-'))"
_CELLS = " UNION ALL ".join(f"""SELECT record_id, '{f}' AS field_name, "{f}" AS c FROM papers WHERE NOT {_MISSING.format(c=f'"{f}"')}""" for f in packed.PACKINGS)
_AND = "regexp_replace({x}, '(^|\\s)(?i:and)(\\s|$)', ' ', 'g')"
#: Letters of cells without line breaks of mark-up and, between authors and outside quotes, the word and.
_LETTERS = f"""WITH c AS ({_CELLS}), b AS (SELECT record_id, field_name, regexp_replace(c, '<[bB][rR]\\s*/?>', ' ', 'g') AS c FROM c),
a AS (SELECT record_id, field_name, CASE WHEN field_name = 'author' THEN array_to_string(list_transform(string_split(c, '"'), lambda x, i: CASE WHEN i % 2 = 1 THEN {_AND.format(x=_AND.format(x="x"))} ELSE x END), ' ') ELSE c END AS c FROM b),
l AS (SELECT record_id, field_name, regexp_replace(c, '[^\\p{{L}}]+', '', 'g') AS l FROM a) SELECT record_id, field_name, md5(l) AS letters FROM l WHERE l <> ''"""


def oracle_sql() -> dict[str, str]:
    return {"p2_letters": _LETTERS, "p6_found": _FOUND, "p6_works": _TABLE}
