"""Normalising columns, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings of a missing cell, lower case.
MISSING_WORDS = ("", "unknown", "unkn", "n/a", "none", "-")

#: White space in the Unicode sense, and the marks that typing leaves without showing.
BLANK = "[\\s\\u00a0\\u1680\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


#: White space that is not the ordinary blank.
ODD_BLANK = "[\\t-\\r\\u0085\\u00a0\\u1680\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def squeezed(c: Column) -> Column:
    """Inner white space as one blank, outer white space removed; null stays null."""
    # most texts need no more than a trim, so the regular expression runs over the others only
    return F.when(c.contains("  ") | c.rlike(ODD_BLANK), F.trim(F.regexp_replace(c, f"{BLANK}+", " "))).otherwise(F.trim(c))


def is_missing(c: Column) -> Column:
    """True for null, blank and the words that stand for a missing value, in any letter case."""
    words = "|".join(w for w in MISSING_WORDS if w)
    return F.coalesce(c.rlike(f"(?i)^{BLANK}*(?:{words})?{BLANK}*$"), F.lit(True))


# Letters with a mark, by the letter they are without it; beyond these, compatibility forms stay.
_MARKED = {"a": "àáâãäåāăą", "c": "çćĉċč", "d": "ď", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥ", "i": "ìíîïĩīĭį", "j": "ĵ", "k": "ķ", "l": "ĺļľ", "n": "ñńņň", "o": "òóôõöōŏő", "r": "ŕŗř", "s": "śŝşšș", "t": "ţťț", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž"}


def without_accents(c: Column) -> Column:
    """Small Latin letters without their marks, marks that stand by themselves off too."""
    return F.regexp_replace(F.translate(c, "".join(_MARKED.values()), "".join(k * len(v) for k, v in _MARKED.items())), "\\p{Mn}+", "")


def present(c: Column) -> Column:
    """The cell as it is, or null where it is missing."""
    return F.when(~is_missing(c), c)


def folded(c: Column) -> Column:
    """Letter case removed; through capitals, so that letters with two small forms agree."""
    return F.lower(F.upper(c))


def without_resolver(c: Column) -> Column:
    """A resolver address or ``doi:`` before a DOI taken off, in any letter case."""
    return F.regexp_replace(c, "(?i)^[\\s\\p{Ps}\\p{Pi}\"'<]*(?:(?:https?://)?(?:dx\\.|www\\.)?doi\\.org/|doi\\s*:?\\s*)+(?=10\\.)", "")


def letters_and_digits(c: Column) -> Column:
    """Letters and digits in order, letter case aside."""
    return folded(F.regexp_replace(c, "[^\\p{L}\\p{N}]+", ""))


# What the bytes 80 to 9F mean in texts of Western Windows systems; blanks where they mean nothing.
_WINDOWS = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"


def western(c: Column) -> Column:
    """A text read as ISO 8859-1 with the further characters of Western Windows systems."""
    return F.translate(c, "".join(map(chr, range(128, 160))), _WINDOWS)


def decoded(c: Column) -> Column:
    """A text whose bytes were read as they are: UTF-8 where they are valid, else Western single bytes; a byte order mark goes."""
    return F.regexp_replace(F.when(F.is_valid_utf8(c), c).otherwise(western(F.decode(c.cast("binary"), "ISO-8859-1"))), "^\\ufeff", "")


def doi_characters(c: Column) -> Column:
    """The beginning of a DOI that consists of characters a DOI may have."""
    return F.regexp_extract(c, "^[0-9a-zA-Z./\\-_:]*", 0)


def bare_doi(c: Column) -> Column:
    """A DOI without resolver, blanks, brackets and full stops around it, in small letters; null if malformed."""
    inner = F.regexp_replace(c, f"^(?:{BLANK}|[\\[\\](){{}}<>])+|(?:{BLANK}|[\\[\\](){{}}<>.])+$", "")
    bare = F.regexp_replace(without_resolver(inner), f"^(?:{BLANK}|[\\[\\](){{}}<>])+", "")
    return F.when(bare.rlike("^10\\.[0-9]+/\\S+$"), F.lower(bare))
