"""Normalising records at ingest: citations, document types, keywords, years, countries, institutions, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import clean
from quillmill.plans import broadcast_if_small

# Document types of other databases, by the type they are harmonised to.
_TYPES = {
    "Article in Press": ["Article; Early Access"],
    "Proceedings Paper": ["Article; Proceedings Paper"],
    "Article": [
        "Article; Discussion", "Article; Letter", "Article; Excerpt", "Article; Chronology", "Article; Correction", "Article; Correction, Addition", "Article; Data Paper",
        "Clinical Study", "Clinical Trial", "Clinical Trial Protocol", "Clinical Trial, Phase I", "Clinical Trial, Phase II", "Clinical Trial, Phase III", "Clinical Trial, Phase IV", "Clinical Trial, Veterinary",
        "Comparative Study", "Controlled Clinical Trial", "Corrected and Republished Article", "Duplicate Publication", "Essay", "Historical Article", "Journal Article", "Letter", "Meta-Analysis",
        "Randomized Controlled Trial", "Randomized Controlled Trial, Veterinary", "Research Support, N.I.H., Extramural", "Research Support, N.I.H., Intramural", "Research Support, Non-U.S. Gov't",
        "Research Support, U.S. Gov't, Non-P.H.S.", "Research Support, U.S. Gov't, P.H.S.", "Research Support, U.S. Government", "Research Support, American Recovery and Reinvestment Act", "Technical Report", "Twin Study", "Validation Study",
    ],
    "Review": [
        "Art Exhibit Review", "Dance Performance Review", "Music Performance Review", "Music Score Review", "Film Review", "TV Review, Radio Review", "TV Review, Radio Review, Video", "Theater Review, Video",
        "Database Review", "Record Review", "Software Review", "Hardware Review", "Systematic Review", "Scientific Integrity Review",
    ],
    "Conference Paper": ["Clinical Conference", "Congress", "Consensus Development Conference", "Consensus Development Conference, NIH"],
}

DOCUMENT_TYPES = {raw: kind for kind, raws in _TYPES.items() for raw in raws}


def citations(note: Column) -> Column:
    """The number in a note: ``cited by:`` off, the whole number before the first semicolon, else the first digits, else 0."""
    bare = F.trim(F.regexp_replace(F.lower(note), "cited by:?", ""))
    first = F.trim(F.element_at(F.split(bare, ";"), 1))
    whole = F.when(first.rlike("^[0-9]{1,9}$"), first.cast("int"))
    digits = F.regexp_extract(bare, "([0-9]{1,9})", 1)
    return F.coalesce(whole, F.when(digits != "", digits.cast("int")), F.lit(0))


def document_type(c: Column) -> Column:
    """The harmonised type of an exact value, or the type as it stands."""
    table = F.create_map(*(F.lit(x) for pair in DOCUMENT_TYPES.items() for x in pair))
    return F.coalesce(F.element_at(table, c), c)


def split_values(c: Column, delimiter: str, lower: bool = False, references: bool = False) -> Column:
    """A delimited cell as an array: squeezed, without empty values and ``note``; references that are a bare year are dropped."""
    values = F.transform(F.split(F.lower(c) if lower else c, delimiter), clean.squeezed)
    kept = F.filter(values, lambda v: (v != "") & (F.lower(v) != "note"))
    return F.filter(kept, lambda v: ~v.rlike(r"^\(?\d{4}\)?$")) if references else kept


def year_of(year: Column, date: Column) -> Column:
    """The year as a number; of a missing one the first four characters of a date."""
    digits = F.regexp_extract(year, "([12][0-9]{3})", 1)
    return F.coalesce(F.when(digits != "", digits.cast("int")), F.when(F.substring(date, 1, 4).rlike("^[12][0-9]{3}$"), F.substring(date, 1, 4).cast("int")))


def filled_forward(rows: DataFrame, value: str, group: str = "doc_id", pos: str = "pos", unknown: str = "UNKNOWN") -> DataFrame:
    """Within a paper an unknown value takes the last known one before it; leading unknown values stay."""
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.coalesce(F.last(F.nullif(F.col(value), F.lit(unknown)), ignorenulls=True).over(w), F.lit(unknown)))


def resolved_countries(mentions: DataFrame, item: str, names: DataFrame) -> DataFrame:
    """``mentions`` with codes replaced by names; ``names`` is a table (code, country). Unknown codes stay."""
    table = broadcast_if_small(names.select(F.upper("code").alias("_code"), F.col("country").alias("_country")))
    return mentions.join(table, F.upper(F.trim(F.col(item))) == F.col("_code"), "left").withColumn(item, F.coalesce("_country", item)).drop("_code", "_country")


def detected_countries(affiliations: DataFrame, countries: DataFrame, key: str = "record_id", text: str = "item") -> DataFrame:
    """(key, pos, country): the country that an affiliation's last part names; rows (key, pos, text).

    Parts are compared as whole, so a country whose name lies in another's is not found by mistake.
    """
    last = clean.letters_and_digits(F.element_at(F.split(F.col(text), ","), -1))
    table = broadcast_if_small(countries.select("country", clean.letters_and_digits(F.col("country")).alias("_k")))
    return affiliations.withColumn("_k", last).join(table, "_k").select(key, "pos", "country")


def detected_institutions(affiliations: DataFrame, key: str = "record_id", text: str = "item") -> DataFrame:
    """(key, pos, institution): the part of an affiliation with the highest ranking word, then the longest, then the first."""
    ranks = [(4, "universi|institut|academ|polytechn"), (3, "college|laborator|hospital|medical center"), (2, "cent(?:er|re)|foundation|agency"), (1, "school|faculty|department|dept")]
    parts = F.transform(F.split(F.col(text), ","), lambda p, i: F.struct(_rank(p, ranks).alias("r"), F.length(F.trim(p)).alias("l"), (-i).alias("i"), F.trim(p).alias("p")))
    return affiliations.select(key, "pos", F.array_max(parts)["p"].alias("institution"))


def _rank(p: Column, ranks: list[tuple[int, str]]) -> Column:
    out = F.lit(0)
    for r, words in reversed(ranks):
        out = F.when(F.lower(p).rlike(words), r).otherwise(out)
    return out


def label(author: Column, year: Column, title: Column, journal: Column, doi: Column) -> Column:
    """``author (year). title. journal. doi:…``"""
    return F.concat(author, F.lit(" ("), year, F.lit("). "), title, F.lit(". "), journal, F.lit(". doi:"), doi, F.lit("."))


def keyword_list(c: Column) -> Column:
    """Commas between keywords as semicolons."""
    return F.translate(c, ",", ";")


def _parts(c: Column, pattern: str) -> Column:
    return F.transform(F.split(F.coalesce(c, F.lit("")), pattern), clean.squeezed)


_PEOPLE = "\\s+and\\s+|;"


def _paired(authors: Column, affiliations: Column) -> Column:
    return F.transform(F.arrays_zip(authors.alias("a"), affiliations.alias("b")), lambda z: F.concat_ws(" ", z["a"], z["b"]))


def author_affiliations(author: Column, affiliation: Column) -> Column:
    """``author affiliation; ...``: place by place, affiliations without an author as they are, authors without one left out."""
    people, places = _parts(author, " and "), _parts(affiliation, ";")
    return F.array_join(F.slice(_paired(people, places), F.lit(1), F.size(places)), "; ")


def scopus_affiliations(author: Column, affiliation: Column, correspondence: Column) -> Column:
    """``author affiliation; ...``: the corresponding author with their own address first, then the others place by place.

    ``correspondence`` is ``authors; address; ...``. Affiliations that hold the address are taken for the corresponding author's; pairs
    end with the shorter of the two lists.
    """
    people, places = _parts(author, _PEOPLE), _parts(affiliation, ";")
    pieces = F.split(F.coalesce(correspondence, F.lit("")), ";")
    address = F.trim(F.try_element_at(pieces, F.lit(2)))
    known = F.coalesce((F.size(pieces) > 1) & (address != "") & (F.trim(pieces[0]) != "") & (F.upper(F.trim(pieces[0])) != "UNKNOWN"), F.lit(False))
    heads = F.when(known, _parts(pieces[0], "\\s+and\\s+")).otherwise(F.array().cast("array<string>"))
    first = F.when(known, F.array(F.concat_ws(" ", heads[0], address))).otherwise(F.array().cast("array<string>"))
    others = F.filter(people, lambda a: ~F.array_contains(heads, a))
    left = F.filter(places, lambda x: ~known | ~F.lower(x).contains(F.lower(address)))
    n = F.least(F.size(others), F.size(left))
    return F.array_join(F.concat(first, F.when(n > 0, _paired(F.slice(others, F.lit(1), n), F.slice(left, F.lit(1), n))).otherwise(F.array().cast("array<string>"))), "; ")


def wos_affiliations(address: Column) -> Column:
    """Addresses that end with full stops as a list between semicolons; full stops after capitals, such as initials, stay."""
    held = F.translate(F.regexp_replace(address, "(?<=[A-Z])\\.", "#"), ";.", ",;")
    return F.translate(F.regexp_replace(held, ";+$", ""), "#", ".")


def wos_backfilled(affiliation: Column, address: Column) -> Column:
    """An unknown affiliation out of the addresses: the mark of the corresponding author off, and the names before the first comma of the others."""
    parts = F.split(address, "\\.")
    head = F.regexp_replace(parts[0], "^.*?\\(Corresponding Author\\), ", "")
    rest = F.transform(F.filter(F.slice(parts, 2, 1_000_000), lambda x: x.contains(",")), lambda x: F.trim(F.regexp_replace(x, "^[^,]*,", "")))
    return F.when(clean.is_missing(affiliation) & ~clean.is_missing(address), F.array_join(F.concat(F.array(head), rest), ". ")).otherwise(affiliation)


def harmonised(papers: DataFrame, source: str) -> DataFrame:
    """Canonical papers of one vendor as the analyses expect them: types, keyword lists, years, and affiliations with their authors."""
    unknown = lambda c: F.when(~clean.is_missing(c), c).otherwise("UNKNOWN")
    author, affiliation = F.col("author"), F.col("affiliation")
    aligned = {
        "scopus": scopus_affiliations(author, affiliation, F.col("correspondence_address1")), "pubmed": author_affiliations(author, affiliation), "wos": wos_affiliations(wos_backfilled(affiliation, F.col("address"))),
    }.get(source, affiliation)
    journal = F.when(clean.is_missing(F.col("abbrev_source_title")), F.col("journal")).otherwise(F.col("abbrev_source_title"))
    return papers.withColumns({
        "document_type": document_type(F.col("document_type")), "keywords": keyword_list(F.col("keywords")), "author_keywords": keyword_list(F.col("author_keywords")), "affiliation": unknown(aligned),
        "abstract": unknown(F.replace(F.col("abstract"), F.lit("[No abstract available]"), F.lit(""))), "abbrev_source_title": journal if source == "scopus" else F.col("abbrev_source_title"),
    })
