"""Cells that hold several values (problem 2): splitting with quotes, list marks and unlike delimiters.

Everything is a column expression; no Python runs per row and nothing is shuffled. A cell is split on its quote
characters: pieces with an odd ordinal are literals, pieces with an even ordinal are split on delimiters, and an array
fold puts the pieces together again with a separator that no text holds, which then gives the
values with their ordinals. Cells without quotes take the direct way through one regular expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import clean

SEP, HOLE = "\u0001", "\u0002"

#: Delimiters of any list that are one character: semicolons, bars, line ends, tabs, bullets.
SINGLE = ";；、|\n\r\t•"

#: Longer delimiters of any list, each with a text without which it cannot occur.
LONGER = {"<": r"<(?i:br)\s*/?>", "//": r"(?:^|(?<=\s))//(?=\s|$)"}

#: Marks before a value: [1], (1), 1), 1. and dots or dashes of a list.
MARK = r"^(?:\[\d{1,4}\]|\(\d{1,3}\)|\d{1,3}[.)](?=\s)|[·‣▪◦*](?=\s))\s*"

EDGE = r"[,;；|/·\n\t]"


@dataclass(frozen=True)
class Packing:
    """How the values of a field may be packed, besides the delimiters of any list.

    more: further delimiters, each with a text without which it cannot occur; weak: a delimiter only where the cell has no other outside its quotes; names: whether
    a comma separates where every part is a full name by itself ("A. Adams, B. Brown" or "Adams A, Brown B").
    """

    more: tuple[tuple[str, str], ...] = ()
    weak: str = ""
    names: bool = False


PACKINGS = {
    "author": Packing(more=(("and", r"(?:^|(?<=\s))(?i:and)(?=\s|$)"), ("AND", r"(?:^|(?<=\s))AND(?=\s|$)"), ("&", r"(?:^|(?<=\s))&(?=\s|$)")), names=True),
    "author_keywords": Packing(more=(("/", r"(?:^|(?<=\s))/(?=\s|$)"), ("·", r"(?:^|(?<=\s))·(?=\s|$)")), weak=",，"),
    "references": Packing(more=(("[", r"(?:^|(?<=\s))\[\d{1,4}\](?=\s)"),)),
    "affiliation": Packing(),
}

#: The two ways in which a name is full without a comma; possessive, so that no long text recurses in the matcher.
INITIALS_FIRST, INITIALS_LAST = r"^(?:\p{Lu}\.[\s-]*+)++[^.]+$", r"^[^.]+\s\p{Lu}{1,3}$"

#: Pieces that an inner fold puts together before an outer one does, so that long cells are not copied for every piece.
FOLD_BLOCK = 256

#: What may stand between a delimiter and the quote that opens a value: blanks and a list mark.
OPENING = r"^\s*(?:\[\d+\]|\(\d+\)|\d+[.)]|[·*])?\s*$"

#: Characters of text since the last delimiter that are carried; longer ones are no list mark.
TAIL = 64


def _plain_quotes(c: Column) -> Column:
    """Enclosing quotes of any shape as straight ones; apostrophes and inner quotes stay."""
    curly = F.regexp_replace(c, f"(^|{EDGE})(\\s*(?:\\[\\d+\\]\\s*)?)[“«„]([^”»“\"]*)[”»“](?=\\s*(?:{EDGE}|$))", '$1$2"$3"')
    single = F.regexp_replace(c, f"(^|{EDGE})(\\s*)['‘]((?:[^'’\"]++|['’](?!\\s*(?:{EDGE}|$)))++)['’](?=\\s*(?:{EDGE}|$))", '$1$2"$3"')
    return F.when(c.contains('"'), c).when(c.contains("“") | c.contains("«") | c.contains("„"), curly).when(c.contains("'") | c.contains("‘"), single).otherwise(c)


def _let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _replacing(hint: str, pattern: str) -> Callable[[Column], Column]:
    return lambda x: F.when(x.contains(hint), F.regexp_replace(x, pattern, SEP)).otherwise(x)


def _strong(c: Column, p: Packing) -> Column:
    """The delimiters as separators; a regular expression runs only over texts that may need it."""
    out = F.translate(c, SINGLE, SEP * len(SINGLE))
    for hint, pattern in (*LONGER.items(), *p.more):
        out = _let(out, _replacing(hint, pattern))
    return out


def _delimited(c: Column, p: Packing, weak: Column | None) -> Column:
    if not p.weak:
        return _strong(c, p)
    commas = F.translate(c, p.weak, SEP * len(p.weak))
    if weak is not None:
        return F.when(weak, commas).otherwise(_strong(c, p))
    return _let(F.struct(c.alias("c"), _strong(c, p).alias("s")), lambda x: F.when(x["s"].contains(SEP), x["s"]).otherwise(F.translate(x["c"], p.weak, SEP * len(p.weak))))


def _folded(cell: Column, p: Packing) -> Column:
    """A cell with quotes as one string whose values stand between separators."""
    odd = lambda i: i % 2 == 1

    def outside(x: Column, i: Column, n: Column, weak: Column) -> Column:
        split = _delimited(x, p, weak)
        after = F.when(i > 0, F.regexp_replace(split, r"^\s*,", SEP)).otherwise(split)
        return F.when(i < n - 1, F.regexp_replace(after, r",\s*$", SEP)).otherwise(after)

    def parts(pieces: Column) -> Column:
        n = F.size(pieces)
        weak = ~_strong(F.array_join(F.filter(pieces, lambda _, i: ~odd(i)), HOLE), p).contains(SEP) if p.weak else F.lit(False)
        return _let(
            weak,
            lambda w: F.transform(
                pieces,
                lambda x, i: F.struct(odd(i).alias("literal"), F.when(odd(i), x).otherwise(outside(x, i, n, w)).alias("text"), (~odd(i) & (x == "") & (i > 0) & (i < n - 1)).alias("doubled")),
            ),
        )

    def carried(t: Column) -> Column:
        bare = F.when(F.length(t) > TAIL, F.regexp_replace(t, r"^\s+|\s+$", "")).otherwise(t)
        return F.when(F.length(bare) > TAIL, "x").otherwise(bare)

    def fold(acc: Column, x: Column) -> Column:
        opens = ~acc["hole"] & acc["tail"].rlike(OPENING)
        # quotes that do not enclose a value, such as those in the middle of a title, belong to it
        literal = F.when(acc["hole"] | opens, x["text"]).otherwise(F.concat(F.lit('"'), x["text"], F.lit('"')))
        text = F.when(x["literal"], literal).when(x["doubled"], F.lit('"')).otherwise(x["text"])
        closed = F.when(x["literal"] & ~opens | x["doubled"], F.lit("x"))
        tail = F.when(x["text"].contains(SEP), F.substring_index(x["text"], SEP, -1)).otherwise(F.concat(acc["tail"], x["text"]))
        return F.struct(F.coalesce(closed, carried(tail)).alias("tail"), x["doubled"].alias("hole"), F.concat(acc["out"], text).alias("out"))

    def joined(acc: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(acc["tail"].alias("tail"), acc["hole"].alias("hole"), F.lit("").alias("out")), fold)
        return _let(inner, lambda r: F.struct(r["tail"].alias("tail"), r["hole"].alias("hole"), F.concat(acc["out"], r["out"]).alias("out")))

    def blocks(ps: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(ps), F.lit(FOLD_BLOCK)), lambda k: F.slice(ps, k, F.lit(FOLD_BLOCK)))

    start = F.struct(F.lit("").alias("tail"), F.lit(False).alias("hole"), F.lit("").alias("out"))
    return _let(_let(F.split(cell, '"'), parts), lambda ps: F.aggregate(blocks(ps), start, joined)["out"])


def _names(v: Column) -> Column:
    """The names of a value: its parts between commas where there are two or more and each is a full name, else the value itself."""
    one = lambda x: F.regexp_replace(x, r"^[\s,]+|[\s,]+$", "")
    parts = F.filter(F.transform(F.split(v, ","), one), lambda x: x != "")
    full = lambda ps: (F.size(ps) > 1) & (F.forall(ps, lambda x: x.rlike(INITIALS_FIRST)) | F.forall(ps, lambda x: x.rlike(INITIALS_LAST)))
    return F.when(v.contains(","), _let(parts, lambda ps: F.when(full(ps), ps).otherwise(F.array(one(v))))).otherwise(F.array(one(v)))


def _tidy(v: Column) -> Column:
    """White space squeezed and the list mark off."""
    return _let(clean.squeezed(v), lambda s: F.when(F.substring(s, 1, 1).rlike(r"[\[(\d·‣▪◦*]"), F.trim(F.regexp_replace(s, MARK, ""))).otherwise(s))


def values_of(cell: Column, packing: Packing) -> Column:
    """The values of a cell, in order; an empty array for a missing cell.

    Inner white space is one blank, outer white space and list marks are off, empty values do not count. What stands inside
    quotes is not separated; a doubled quote there is one quote. A quote that is never closed encloses the rest.
    """
    joined = _let(_plain_quotes(cell), lambda q: F.when(q.contains('"'), _folded(q, packing)).otherwise(_delimited(q, packing, None)))
    values = F.split(joined, SEP)
    if packing.names:
        values = F.flatten(F.transform(values, _names))
    values = F.filter(F.transform(values, _tidy), lambda v: v != "")
    return F.when(clean.is_missing(cell), F.array().cast("array<string>")).otherwise(values)


def unpacked(df: DataFrame, key: str, packings: dict[str, Packing] | None = None) -> DataFrame:
    """(key, field_name, pos, item): every value of the packed fields of ``df``, positions from 0.

    Defined results: missing cells (null, blank, the words for missing) give no row; a cell of delimiters only gives no row;
    equal values of a cell come out each with its position; repeated rows and null keys come out as they are;
    columns of other names are not read. One scan, no shuffle.
    """
    packings = packings or PACKINGS
    fields = F.array(*(F.struct(F.lit(f).alias("field_name"), values_of(F.col(f"`{f}`"), p).alias("_values")) for f, p in packings.items()))
    lists = df.select(F.col(key), F.inline(fields))
    return lists.select(key, "field_name", F.posexplode("_values").alias("pos", "item"))
