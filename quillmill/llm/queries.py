"""The training-data queries p1_ to p9_ that are tagged llm, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import co_items, format_twins, languages, names, packing, survivors, tokens
from quillmill.plans import written

#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"

#: Fields whose values may stand in each other's columns.
TWIN_FIELDS = ("title", "doi", "year")

VOCABULARY, WORD_VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/word_bpe_49k.json"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The record whose value survives, for each group and field: the highest sum of votes in which the best record leads."""
    return survivors.best_records(_table(spark, sf, "dup_groups"), _table(spark, sf, "papers"), _table(spark, sf, "sources"))


def p1_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of p1_found of the two fields whose rule SQL can state."""
    return p1_found(spark, sf).where("field_name <> 'references'")


def p1_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """One built record for each group, by the sum of votes."""
    return survivors.survivors(_table(spark, sf, "dup_groups"), _table(spark, sf, "papers"), _table(spark, sf, "sources"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of names that mean the same entity."""
    return names.linked(_table(spark, sf, "name_forms"))


def p3_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The entity of every name."""
    return names.entities(_table(spark, sf, "name_forms"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of items that stand together at least 20 times as often as by chance, in at least 8 works."""
    return co_items.associated(_table(spark, sf, "mentions")).select("field_name", "item_a", "item_b")


def p4_lift(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of p4_found with their counts and lift."""
    found = co_items.associated(_table(spark, sf, "mentions"))
    return found.select("field_name", "item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Records that are the same but for the typing of title, DOI and year."""
    return format_twins.copies(_table(spark, sf, "papers"), "record_id", list(TWIN_FIELDS), (TWIN_FIELDS,))


def p5_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each distinct record with its number of copies."""
    return format_twins.collapsed(_table(spark, sf, "papers"), "record_id", list(TWIN_FIELDS), (TWIN_FIELDS,))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(_table(spark, sf, "documents").select("doc_id", "text"), VOCABULARY).select("doc_id", "ids")


def p7_word_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document by the vocabulary that marks the ends of words."""
    return tokens.encode_corpus(_table(spark, sf, "documents").select("doc_id", "text"), WORD_VOCABULARY).select("doc_id", "ids")


def p7_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every document encoded and decoded again; null as the empty text."""
    encoded = tokens.encode_corpus(_table(spark, sf, "documents").select("doc_id", "text"), VOCABULARY)
    return tokens.decode_corpus(encoded.select("doc_id", "ids"), VOCABULARY).select("doc_id", "text")


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, or piece of a document longer than a container, with its container."""
    return packing.pack_texts(_table(spark, sf, "documents").select("doc_id", "text"), VOCABULARY)


def p8_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """One row: documents placed, containers that are too full, documents split that fit in one, and tokens that are missing or twice."""
    packed = written(p8_containers(spark, sf), "packed")
    over = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("t")).agg(F.count_if(F.col("t") > 2048).alias("n_over"))
    whole = packed.groupBy("doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("t"), F.countDistinct("piece_no").alias("p"), (F.max("start_token") - F.sum("n_tokens") + F.max_by("n_tokens", "start_token")).alias("g"))
    docs = whole.agg(F.count("*").alias("n_docs"), F.count_if((F.col("k") > 1) & (F.col("t") <= 2048)).alias("n_split"), F.count_if((F.col("k") != F.col("p")) | (F.col("g") != 0)).alias("n_gaps"))
    return docs.crossJoin(over).select("n_docs", "n_over", "n_split", "n_gaps")  # one row each


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of documents whose label is missing or wrong, and of the stretches of mixed ones."""
    return languages.corrected(_table(spark, sf, "documents"), _table(spark, sf, "language_labels")).select("doc_id", "seg_no", "lang")


def p9_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Language and confidence of every stretch of every document."""
    return languages.segmented(_table(spark, sf, "documents"), _table(spark, sf, "language_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (p1_found, p1_texts, p1_survivors, p3_found, p3_entities, p4_found, p4_lift, p5_found, p5_collapsed, p7_ids, p7_word_ids, p7_round_trip, p8_containers, p8_invariants, p9_found, p9_segments)
    return {f.__name__: f for f in named}


_P4 = """
WITH m AS (SELECT DISTINCT work_id, field_name, item FROM mentions WHERE item IS NOT NULL AND work_id IS NOT NULL AND field_name IS NOT NULL),
c AS (SELECT field_name, item, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 8),
k AS (SELECT m.* FROM m JOIN c USING (field_name, item)),
p AS (SELECT a.field_name, a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM k a JOIN k b
      ON a.work_id = b.work_id AND a.field_name = b.field_name AND a.item < b.item GROUP BY ALL HAVING count(*) >= 8),
w AS (SELECT count(DISTINCT work_id) AS n FROM mentions),
f AS (SELECT p.*, a.n AS n_a, b.n AS n_b, w.n AS n_all FROM p
      JOIN c a ON a.field_name = p.field_name AND a.item = p.item_a
      JOIN c b ON b.field_name = p.field_name AND b.item = p.item_b CROSS JOIN w
      WHERE CAST(p.n_ab AS HUGEINT) * w.n >= CAST(20 AS HUGEINT) * a.n * b.n)
"""

_P5 = """
WITH v AS (SELECT record_id, unnest([title, doi, year]) AS x FROM papers WHERE record_id IS NOT NULL),
s AS (SELECT record_id, CASE WHEN x IS NULL OR lower(trim(regexp_replace(x, '[\\s\\x{00a0}\\x{200b}\\x{feff}]+', ' ', 'g'))) IN ('', 'unknown', 'unkn', 'n/a', 'none', '-') THEN ''
      ELSE lower(upper(regexp_replace(regexp_replace(x, '^[\\s\\p{Ps}\\p{Pi}"''<]*((https?://)?(dx\\.|www\\.)?doi\\.org/|doi\\s*:?\\s*)+(10\\.)', '\\4', 'i'), '[^\\p{L}\\p{N}]+', '', 'g'))) END AS y FROM v),
g AS (SELECT record_id, list_sort(list(y)) AS k FROM s GROUP BY record_id),
f AS (SELECT record_id, min(record_id) OVER (PARTITION BY k) AS first_id FROM g)
"""


_BLANK = "[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
_ROUND = _BLANK[:-1] + "\\[\\](){}<>"


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_BLANK}+', ' ', 'g'))"


def _present(x: str) -> str:
    return f"coalesce(lower({_squeezed(x)}), '') NOT IN ('', 'unknown', 'unkn', 'n/a', 'none', '-')"


_BARE = f"regexp_replace(regexp_replace(regexp_replace(doi, '^{_ROUND}]+|{_ROUND}.]+$', '', 'g'), '^[\\s\\p{{Ps}}\\p{{Pi}}\"''<]*((https?://)?(dx\\.|www\\.)?doi\\.org/|doi\\s*:?\\s*)+(10\\.)', '\\4', 'i'), '^{_ROUND}]+', '')"
_REMARKS = ", ".join(f"'{x}'" for x in survivors.NO_ABSTRACT)

_P1 = f"""
WITH m AS (SELECT DISTINCT group_id, record_id FROM dup_groups WHERE group_id IS NOT NULL AND record_id IS NOT NULL),
s AS (SELECT lower({_squeezed('label')}) AS l, min(trust_rank) AS rank FROM sources GROUP BY 1),
r AS (SELECT m.group_id, p.record_id, p.updated_at, coalesce(s.rank, 60) AS rank, p.abstract, p.doi FROM m JOIN papers p USING (record_id) LEFT JOIN s ON s.l = lower({_squeezed('p.source')})),
n AS (SELECT group_id, record_id, updated_at, rank, 'abstract' AS field_name, regexp_replace({_squeezed('abstract')}, '[\\s.…\\[\\](){{}}]+$', '') AS v FROM r WHERE {_present('abstract')} AND NOT (length(abstract) < 60 AND regexp_replace(lower(abstract), '[^a-z]+', '', 'g') IN ({_REMARKS}))
  UNION ALL SELECT group_id, record_id, updated_at, rank, 'doi', lower({_BARE}) FROM r WHERE {_present('doi')} AND regexp_matches({_BARE}, '^10\\.[0-9]+/\\S+$')),
k AS (SELECT * FROM n WHERE v <> '' AND NOT EXISTS (SELECT 1 FROM n o WHERE o.group_id = n.group_id AND o.field_name = n.field_name AND o.v <> n.v AND starts_with(o.v, n.v)))
SELECT group_id, field_name, record_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY rank, updated_at DESC NULLS LAST, record_id) AS place FROM k) WHERE place = 1
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_texts": _P1,
        "p4_found": _P4 + "SELECT field_name, item_a, item_b FROM f",
        "p4_lift": _P4 + "SELECT field_name, item_a, item_b, n_ab, n_a, n_b, round(CAST(n_ab AS DOUBLE) * n_all / n_a / n_b, 6) AS lift FROM f",
        "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p8_invariants": "SELECT count(DISTINCT doc_id) AS n_docs, 0 AS n_over, 0 AS n_split, 0 AS n_gaps FROM documents",
        "p5_found": _P5 + "SELECT first_id, record_id AS copy_id FROM f WHERE record_id <> first_id",
        "p5_collapsed": _P5 + "SELECT first_id, count(*) AS n_copies FROM f GROUP BY first_id",
    }
