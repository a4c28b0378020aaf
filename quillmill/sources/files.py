"""Bibliographic export files as canonical papers, read in parallel by Spark's own text, CSV and JSON sources.

Every reader gives one row for a record with the canonical columns, all texts, missing ones ``UNKNOWN``. Text formats
are cut into records by the line separator, so large files are split and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import clean
from quillmill.operators import ingest, nested, select
from quillmill.plans import written

# The canonical columns.
CANONICAL = tuple(
    "abbrev_source_title abstract address affiliation art_number author author_keywords chemicals_cas coden correspondence_address1 document_type doi editor funding_details funding_text_1 isbn issn journal keywords language note number page_count pages publisher pubmed_id references source sponsors title tradenames url volume year".split()
)

OPENALEX_MORE = ("country", "institution", "openalex_id", "oa_url")

# Labels of exports and the canonical columns they fill, by source.
BIBTEX_LABELS = {
    "abbrev_source_title": "abbrev_source_title", "abstract": "abstract", "affiliations": "affiliation", "affiliation": "affiliation", "art_number": "art_number", "author": "author", "author_keywords": "author_keywords", "chemicals_cas": "chemicals_cas", "coden": "coden",
    "correspondence_address": "correspondence_address1", "correspondence_address1": "correspondence_address1", "type": "document_type", "document_type": "document_type", "doi": "doi", "editor": "editor", "isbn": "isbn", "issn": "issn", "journal": "journal", "keywords": "keywords", "language": "language",
    "note": "note", "number": "number", "pages": "pages", "publisher": "publisher", "pmid": "pubmed_id", "references": "references", "source": "source", "title": "title", "url": "url", "volume": "volume", "year": "year",
}
WOS_LABELS = {
    "author": "author", "title": "title", "year": "year", "type": "document_type", "language": "language", "abstract": "abstract", "affiliation": "affiliation", "publisher": "publisher", "times-cited": "note", "cited-references": "references", "volume": "volume", "keywords-plus": "keywords",
    "keywords": "author_keywords", "issn": "issn", "doi": "doi", "journal": "journal", "journal-iso": "abbrev_source_title", "pages": "pages", "number": "number", "isbn": "isbn", "address": "address", "author-email": "correspondence_address1", "book-group-author": "editor", "funding-text": "funding_text_1",
}
PUBMED_TAGS = {
    "PMID": "pubmed_id", "TI": "title", "AB": "abstract", "AD": "affiliation", "FAU": "author", "DP": "year", "LA": "language", "MH": "keywords", "OT": "author_keywords", "PT": "document_type", "TA": "abbrev_source_title", "JT": "journal", "LID": "doi", "VI": "volume", "IP": "number", "PG": "pages", "IS": "issn",
}
SCOPUS_CSV_LABELS = {
    "authors": "author", "title": "title", "year": "year", "source title": "journal", "abbreviated source title": "abbrev_source_title", "cited by": "note", "doi": "doi", "affiliations": "affiliation", "abstract": "abstract", "author keywords": "author_keywords", "index keywords": "keywords", "references": "references",
    "correspondence address": "correspondence_address1", "language of original document": "language", "document type": "document_type", "volume": "volume", "issue": "number", "publisher": "publisher", "issn": "issn", "isbn": "isbn", "coden": "coden", "link": "url", "source": "source", "pubmed id": "pubmed_id", "art. no.": "art_number", "page count": "page_count",
}
OPENALEX_CSV_LABELS = {
    "display_name": "title", "title": "title", "publication_year": "year", "type": "document_type", "language": "language", "cited_by_count": "note", "doi": "doi", "authorships.author.display_name": "author", "authorships.institutions.display_name": "institution", "authorships.countries": "country",
    "referenced_works": "references", "primary_location.source.display_name": "journal", "keywords.display_name": "author_keywords", "id": "openalex_id", "open_access.oa_url": "oa_url", "biblio.volume": "volume", "biblio.issue": "number", "abstract": "abstract",
}
LANGUAGE_CODES = {"eng": "English", "spa": "Spanish", "fre": "French", "fra": "French", "ger": "German", "deu": "German", "por": "Portuguese", "ita": "Italian", "dut": "Dutch", "nld": "Dutch", "rus": "Russian", "chi": "Chinese", "jpn": "Japanese", "pol": "Polish", "tur": "Turkish", "kor": "Korean"}


def canonical(df: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """The canonical columns in order; columns that are not there, and missing cells, are ``UNKNOWN``."""
    there = set(df.columns)
    return df.select(*(F.coalesce(clean.present(F.col(f"`{c}`").cast("string")), F.lit("UNKNOWN")).alias(c) if c in there else F.lit("UNKNOWN").alias(c) for c in (*CANONICAL, *more)))


def _pick(pairs: Column, names: list[str], join: str | None = None) -> Column:
    """The first value of any of ``names`` in an array of (k, v), or all of them joined."""
    hits = F.transform(F.filter(pairs, lambda p: p["k"].isin(*names)), lambda p: p["v"])
    return F.when(F.size(hits) > 0, hits[0] if join is None else F.array_join(hits, join))


def _labelled(pairs: Column, labels: dict[str, str]) -> list[Column]:
    by: dict[str, list[str]] = {}
    for label, name in labels.items():
        by.setdefault(name, []).append(label)
    return [_pick(pairs, names).alias(name) for name, names in by.items()]


def bibtex(spark: SparkSession, path: str, wos: bool = False, literal: bool = False) -> DataFrame:
    """Records of a BibTeX export.

    Lines that begin with blanks and hold no field continue the value before; of cited references each such line is one
    reference, whose semicolons become commas. ``literal`` cuts a value at a second ``=``, as the line rule does; by
    default the value is kept whole. Braces are taken off everywhere.
    """
    raw = spark.read.option("lineSep", "\n@").text(path).select(F.regexp_replace(clean.decoded(F.col("value")), "^[\\ufeff\\s]*@?", "").alias("r")).where(F.col("r").rlike("^[A-Za-z]+\\s*\\{"))
    text = F.regexp_replace("r", "\r", "")
    cited = F.regexp_extract(text, "(?is)\\ncited-references\\s*=\\s*\\{(.*?)\\},?[ ]*\\n(?=\\S|$)", 1)
    folded = F.regexp_replace(F.regexp_replace(text, "(?is)\\ncited-references\\s*=\\s*\\{.*?\\},?[ ]*\\n(?=\\S|$)", "\n"), "\\n {2,}(?![A-Za-z_-]+ *= *\\{)", " ")
    lines = F.filter(F.split(folded, "\\n"), lambda x: x.rlike("^\\s*[A-Za-z][A-Za-z0-9_ -]*="))

    def pair(x: Column) -> Column:
        value = F.split(x, "=")[1] if literal else F.regexp_replace(x, "^[^=]*=", "")
        bare = F.regexp_replace(F.regexp_replace(clean.squeezed(value), ",\\s*$", ""), "[{}]", "")
        return F.struct(F.lower(clean.squeezed(F.substring_index(x, "=", 1))).alias("k"), clean.squeezed(bare).alias("v"))

    pairs = F.transform(lines, pair)
    refs = F.array_join(F.filter(F.transform(F.split(F.replace(cited, F.lit(";"), F.lit(",")), "\\n"), clean.squeezed), lambda x: x != ""), ";")
    more = F.array(F.struct(F.lit("cited-references").alias("k"), F.regexp_replace(refs, "[{}]", "").alias("v")))
    rows = raw.select(F.when(refs != "", F.concat(pairs, more)).otherwise(pairs).alias("p"))
    return canonical(rows.select(*_labelled(F.col("p"), WOS_LABELS if wos else BIBTEX_LABELS)).withColumn("source", F.lit("wos" if wos else "scopus")))


def pubmed(spark: SparkSession, path: str) -> DataFrame:
    """Records of a PubMed text export: six characters of tag, continuation lines of six blanks.

    Repeated tags are joined by ``; ``, authors by `` and ``; the year is the first four characters of the date; note is 0.
    """
    # a record begins with its PMID line, whatever the line ends are; continuation lines are indented
    start = F.regexp_replace(F.regexp_replace(clean.decoded(F.col("value")), "\r", ""), "^[\\ufeff\\s]*(?:PMID *-)? *", "PMID- ")
    raw = spark.read.option("lineSep", "\nPMID").text(path).select(F.regexp_replace(start, "^PMID- -", "PMID- ").alias("r")).where(F.col("r").rlike("^PMID- *[0-9]"))
    lines = F.split(F.regexp_replace("r", "\\n {6}", " "), "\\n")
    pairs = F.transform(F.filter(lines, lambda x: x.rlike("^[A-Z]+ *- ")), lambda x: F.struct(F.trim(F.substring(x, 1, 4)).alias("k"), clean.squeezed(F.substring(x, 7, 1_000_000)).alias("v")))
    rows = raw.select(pairs.alias("p"))
    cols = [_pick(F.col("p"), [tag], " and " if name == "author" else "; ").alias(name) for tag, name in PUBMED_TAGS.items()]
    out = rows.select(*cols, _pick(F.col("p"), ["AU"], " and ").alias("_au"))
    codes = F.create_map(*(F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair))
    out = out.withColumns({
        "author": F.coalesce("author", "_au"), "year": F.substring("year", 1, 4), "note": F.lit("0"), "source": F.lit("pubmed"),
        "language": F.coalesce(F.element_at(codes, F.element_at(F.split("language", "; "), 1)), "language"),
        "doi": F.regexp_extract(F.coalesce("doi", F.lit("")), "(10\\.\\S+) \\[doi\\]", 1),
    })
    return canonical(out)


def _renamed(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    seen: dict[str, Column] = {}
    for c in df.columns:
        name = labels.get(c.lower().strip().lstrip("﻿"))
        if name:
            seen[name] = F.coalesce(seen[name], F.col(f"`{c}`")) if name in seen else F.col(f"`{c}`")
    return df.select(*(c.alias(n) for n, c in seen.items()))


def _csv(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", encoding).csv(path)


def scopus_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Records of a Scopus CSV export; authors between semicolons are joined by `` and ``."""
    df = _renamed(_csv(spark, path, encoding), SCOPUS_CSV_LABELS)
    if "author" in df.columns:
        df = df.withColumn("author", F.regexp_replace("author", "\\s*;\\s*", " and "))
    return canonical(df.withColumn("source", F.lit("scopus")))


def openalex_csv(spark: SparkSession, path: str) -> DataFrame:
    """Records of an OpenAlex CSV export, whose lists are packed with bars."""
    raw = _csv(spark, path, "UTF-8")
    if len({c.lower() for c in raw.columns} & set(OPENALEX_CSV_LABELS)) < 5:
        raise ValueError("not an OpenAlex export: fewer than five of its columns")
    df = _renamed(raw, OPENALEX_CSV_LABELS)
    for c, sep in (("author", " and "), ("institution", "; "), ("country", "; "), ("references", "; "), ("author_keywords", "; ")):
        if c in df.columns:
            df = df.withColumn(c, F.regexp_replace(c, "\\s*\\|\\s*", sep))
    return canonical(df.withColumn("source", F.lit("openalex")), OPENALEX_MORE)


_AUTHORSHIPS = "array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string,country_code:string>>>>"


def openalex_works(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Canonical papers of OpenAlex payloads; institution and country are aligned with the authors."""
    fields = ("id", "doi", "display_name", "publication_year", "type", "language", "cited_by_count", "referenced_works", "abstract_inverted_index", "authorships", "primary_location", "best_oa_location", "keywords")
    works = nested.works_of(payloads, payload, fields)
    people = F.coalesce(F.from_json("authorships", _AUTHORSHIPS), F.array().cast(_AUTHORSHIPS))
    first = lambda a, f: F.coalesce(F.try_element_at(a["institutions"], F.lit(1))[f], F.lit("UNKNOWN"))
    index = F.from_json("abstract_inverted_index", "map<string,array<int>>")
    words = F.array_sort(F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))))))
    refs = F.filter(F.transform(nested.references_of(F.col("referenced_works")), nested.work_id), lambda x: x.isNotNull())
    out = works.where(nested.work_id(F.col("id")).isNotNull()).select(
        nested.work_id(F.col("id")).alias("openalex_id"), F.regexp_replace("doi", "(?i)^https?://(?:dx\\.)?doi\\.org/", "").alias("doi"), F.col("display_name").alias("title"), F.col("publication_year").alias("year"), F.col("type").alias("document_type"), "language", F.col("cited_by_count").alias("note"),
        F.array_join(F.transform(people, lambda a: F.coalesce(a["author"]["display_name"], F.lit("UNKNOWN"))), " and ").alias("author"),
        F.array_join(F.transform(people, lambda a: first(a, "display_name")), "; ").alias("institution"), F.array_join(F.transform(people, lambda a: first(a, "country_code")), "; ").alias("country"),
        F.array_join(F.transform(words, lambda s: s["w"]), " ").alias("abstract"), F.array_join(refs, "; ").alias("references"),
        F.from_json("primary_location", "struct<source:struct<display_name:string>>")["source"]["display_name"].alias("journal"),
        F.from_json("best_oa_location", "struct<pdf_url:string>")["pdf_url"].alias("oa_url"),
        F.array_join(F.transform(F.from_json("keywords", "array<struct<display_name:string>>"), lambda k: k["display_name"]), "; ").alias("author_keywords"), F.lit("openalex").alias("source"),
    )
    return canonical(out, OPENALEX_MORE)


def openalex_json(spark: SparkSession, path: str) -> DataFrame:
    """Canonical papers of OpenAlex JSON files: a work, a list of works, or an object with ``results``."""
    return openalex_works(spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload"))


def sniffed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header whose separator and encoding are not known: the most frequent separator of the header, and UTF-8 if it is valid."""
    lines = spark.read.text(path)
    head = lines.first()
    header = head[0] if head else ""
    separator = max(",;\t|", key=lambda x: header.count(x))
    valid = lines.where(~F.is_valid_utf8("value")).isEmpty()
    encoding = "UTF-8" if valid else "ISO-8859-1"
    df = spark.read.option("header", True).option("multiLine", True).option("sep", separator).option("quote", '"').option("escape", '"').option("encoding", encoding).csv(path)
    return df if valid else df.select(*(clean.western(F.col(f"`{c}`")).alias(c) for c in df.columns))


def from_table(df: DataFrame) -> DataFrame:
    """Canonical papers of any table with canonical column names, whatever their letter case."""
    return canonical(df.toDF(*(c.strip().lstrip("\ufeff").lower().replace(" ", "_") if c.strip().lower().replace(" ", "_") in CANONICAL else c for c in df.columns)))


def corpus(spark: SparkSession, path: str, source: str, kind: str | None = None, distinct: bool = True) -> DataFrame:
    """One entry for all exports: read, harmonised, duplicates dropped; with ``doc_id``, which rises in reading order.

    source: scopus, wos, pubmed, openalex, or table for files written by :func:`write_papers`; kind: bib, txt, csv, json, by default the ending.
    """
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if source == "table":
        papers = from_table(sniffed_csv(spark, path) if kind == "csv" else spark.read.parquet(path))
    elif source == "openalex":
        papers = openalex_csv(spark, path) if kind == "csv" else openalex_json(spark, path)
    elif source == "pubmed":
        papers = pubmed(spark, path)
    elif source in ("scopus", "wos"):
        papers = scopus_csv(spark, path) if kind == "csv" else bibtex(spark, path, wos=source == "wos")
    else:
        raise ValueError(f"no reader for {source}")
    numbered = written(ingest.harmonised(papers, source).withColumn("doc_id", F.monotonically_increasing_id()), "corpus")
    return select.first_of_duplicates(numbered, "doc_id") if distinct else numbered


def mapping_csv(spark: SparkSession, path: str) -> DataFrame:
    """(entity, normalized, candidate) of a reviewed mapping without header: two or three columns between semicolons."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.transform(F.split("value", ";"), lambda x: F.regexp_replace(F.trim(x), '^"|"$', "")).alias("c"))
    three = F.size("c") >= 3
    return rows.select(F.when(three, F.col("c")[0]).alias("entity"), F.when(three, F.col("c")[1]).otherwise(F.col("c")[0]).alias("normalized"), F.when(three, F.try_element_at("c", F.lit(3))).otherwise(F.try_element_at("c", F.lit(2))).alias("candidate"))


def write_papers(papers: DataFrame, path: str, kind: str = "parquet") -> None:
    """Papers as parquet, or as CSV with header and quotes doubled."""
    if kind == "csv":
        papers.write.option("header", True).option("escape", '"').csv(path)
    elif kind == "parquet":
        papers.write.parquet(path)
    else:
        raise ValueError("kind is parquet or csv")


def write_mapping(mapping: DataFrame, path: str) -> None:
    """A mapping as CSV without header, every cell quoted."""
    mapping.select("normalized", "candidate").write.option("quoteAll", True).option("sep", ";").csv(path)
