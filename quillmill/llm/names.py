"""Variant spellings of names (problem 3): canonical rewritings, equi-joins, and the rarity of a rewriting.

Every name is rewritten by rules: letter case, accents and titles off, nicknames and legal forms replaced, tokens reordered, given
names cut to initials, single letters left out (so that two spellings one typing error apart share a rewriting). Rewritings
are exploded and joined by equality only. How far a rewriting may be trusted is its rarity, the score: one over the number of
names that it may stand for. A spelling is replaced by another only if that one is more frequent; a nickname of several
names, and initials, stand for a full name only if a single one of that surname has them (or a single one in the same country or
with the same middle initial); an abbreviated title belongs to a full one only if it abbreviates no other. People of
one name are told apart by country and middle initial where several are known.

Groups are never paired within: each spelling meets the most frequent spelling of its rewriting, found by an
aggregation that combines on the map side. Tables of nicknames, legal forms, particles and small words are a parameter.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import clean
from quillmill.plans import BROADCAST_ROWS, broadcast_if_small, looked_up, split_join, written

#: Rows of a table of words or people that may pass through the driver; several such tables may be sent at once.
FEW = BROADCAST_ROWS // 10

# Nicknames of given names, small letters without accents; one may belong to several names.
NICKNAMES = {
    "abigail": "abby gail", "abraham": "abe bram", "adelaide": "addie della", "agnes": "aggie nessie", "albert": "al bert bertie", "alexander": "alex alec sasha sandy xander", "alexandra": "alex sandra sasha alexa", "alfred": "alf fred freddie",
    "alice": "allie", "amanda": "mandy", "andrew": "andy drew", "angela": "angie", "anna": "annie ania anya nan", "anthony": "tony ant", "antonio": "toni tony tonio", "arthur": "art artie", "barbara": "barb babs barbie",
    "beatriz": "bea trixie", "benjamin": "ben benny benji", "bernard": "bernie", "bridget": "biddy bridie", "calvin": "cal", "carolina": "caro lina", "caroline": "carrie caro", "catalina": "cata lina", "charles": "charlie chuck chas",
    "charlotte": "lottie", "christina": "chris tina chrissie", "christopher": "chris kit topher", "clifford": "cliff", "concepcion": "concha conchita", "constance": "connie", "cynthia": "cindy", "daniel": "dan danny", "david": "dave davy",
    "deborah": "deb debbie debby", "dennis": "denny", "dolores": "lola", "dominic": "dom nic", "donald": "don donnie", "dorothy": "dot dottie dolly", "douglas": "doug", "edith": "edie", "edmund": "ed eddie ned", "edward": "ed eddie ned ted teddy",
    "edwin": "ed eddie", "eduardo": "edu lalo", "eleanor": "ellie nell nora elly", "elizabeth": "liz lizzie beth betty eliza bess", "emanuele": "lele", "enrique": "quique", "ernest": "ernie", "eugene": "gene", "ferdinand": "ferdi", "florence": "flo flossie",
    "frances": "fran francie", "francesco": "franco cesco", "francis": "frank", "francisco": "paco pancho curro fran", "franklin": "frank", "frederick": "fred freddy freddie", "frederik": "fred rik freddy fritz", "friedrich": "fritz friedel",
    "gabriel": "gabe gabi", "geoffrey": "geoff", "george": "georgie", "gerald": "gerry jerry", "gertrude": "trudy gertie", "giovanni": "gianni vanni", "giuseppe": "beppe peppe pino", "gregory": "greg", "guadalupe": "lupe", "guillermo": "memo guille",
    "gustav": "gus", "harold": "harry hal", "harriet": "hattie", "heinrich": "heinz", "helena": "lena helen", "henry": "harry hank", "herbert": "herb bert", "hermann": "manni", "ignacio": "nacho", "isabella": "bella izzy", "jacob": "jake jack", "jacqueline": "jackie",
    "james": "jim jimmy jamie", "janet": "jan", "jeffrey": "jeff", "jennifer": "jen jenny jenni", "jeremy": "jerry", "jesus": "chus chuy", "joachim": "jochen achim", "johannes": "hans johan jan", "john": "jack johnny", "jonathan": "jon", "jose": "pepe chepe",
    "josefina": "pepa pepita fina", "joseph": "joe joey", "joshua": "josh", "judith": "judy", "karl": "kalle", "katherine": "kate kathy katie kat kitty", "kenneth": "ken kenny", "kimberly": "kim", "lawrence": "larry", "leonard": "leo len lenny", "lewis": "lew",
    "lillian": "lil lilly", "louis": "lou louie", "lucia": "lucy", "luis": "lucho", "magdalena": "lena magda", "manuel": "manolo manu", "margaret": "peggy maggie meg marge", "maria": "mia", "martha": "marty", "martin": "marty", "matilda": "tilly mattie", "matthew": "matt matty",
    "maximilian": "max", "melanie": "mel", "mercedes": "merche", "michael": "mike mick mickey", "mikhail": "misha", "miriam": "mimi", "mohammed": "mo", "nancy": "nan", "natalia": "natasha talia", "nathaniel": "nat nate", "nicholas": "nick nicky", "nikolai": "kolya",
    "olivia": "livvy liv", "oliver": "ollie", "pamela": "pam", "patricia": "pat patty tricia trish", "patrick": "pat paddy", "peter": "pete", "philip": "phil pip", "priscilla": "cilla", "rafael": "rafa", "raymond": "ray", "rebecca": "becky becca", "reginald": "reg reggie",
    "richard": "rick dick rich richie", "robert": "bob rob bobby robbie bert", "roberto": "beto", "rodney": "rod", "roger": "rodge", "ronald": "ron ronnie", "rosario": "charo", "rudolf": "rudi", "russell": "russ", "salvatore": "toto turi", "samantha": "sam", "samuel": "sam sammy",
    "santiago": "santi", "sebastian": "seb basti", "sergei": "serge", "sophia": "sophie", "stanley": "stan", "stephanie": "steph", "stephen": "steve stevie", "steven": "steve stevie", "stuart": "stu", "susanna": "sue susie susan", "sylvia": "syl", "teresa": "terry tess tessa",
    "theodor": "theo", "theodore": "theo", "thomas": "tom tommy", "timothy": "tim timmy", "ulrich": "uli", "valentina": "vale tina", "veronica": "ronnie vero", "victor": "vic", "victoria": "vicky vicki tori", "viktor": "vik", "vincent": "vince vinny", "virginia": "ginny",
    "vladimir": "vova volodya", "walter": "walt wally", "wilhelm": "willi", "william": "bill will willy billy liam", "winifred": "winnie", "zachary": "zach zack",
}

# Words of institutions' kinds in other spellings and languages.
KINDS = {
    "university": "univ u universidad universidade universite universitat universita universiteit uni", "state": "st estatal", "national": "natl nat nacional", "laboratory": "lab laboratorio laboratories labs",
    "institute": "inst instituto institut", "technology": "tech technol tecnologico technological tecnologia", "academy": "acad academia", "sciences": "sci ciencias science", "college": "coll", "agriculture": "agr agric agricultural",
    "medical": "med medico medicine", "center": "ctr centro centre cent", "hospital": "hosp", "school": "sch", "research": "res",
}

# Words that carry no meaning in names.
SMALL_WORDS = frozenset("of on in the and for de la le el del des du an a und der".split())
PARTICLES = frozenset("van von der den de del della di da dos das du la le al el bin ibn ter ten".split())
TITLES = frozenset("dr prof professor mr mrs".split())
JOURNAL_WORDS = {"j": "journal", "q": "quarterly"}


@dataclass(frozen=True)
class Tables:
    """What the rules look up: a caller's own tables may be longer, or of other languages.

    nicknames and kinds: words by what they stand for; a nickname of one name is replaced at once, one of several where a single one fits.
    """

    nicknames: dict[str, str] = field(default_factory=lambda: NICKNAMES)
    kinds: dict[str, str] = field(default_factory=lambda: KINDS)
    small_words: frozenset[str] = SMALL_WORDS
    particles: frozenset[str] = PARTICLES
    titles: frozenset[str] = TITLES
    journal_words: dict[str, str] = field(default_factory=lambda: JOURNAL_WORDS)

    def __post_init__(self) -> None:
        names: dict[str, list[str]] = defaultdict(list)
        for g, ns in self.nicknames.items():
            for n in ns.split():
                names[n].append(g)
        object.__setattr__(self, "given", {n: gs[0] for n, gs in names.items() if len(gs) == 1 and n not in self.nicknames})
        object.__setattr__(self, "several", {n: gs for n, gs in names.items() if len(gs) > 1 or n in self.nicknames})
        object.__setattr__(self, "kind", {n: k for k, ns in self.kinds.items() for n in (*ns.split(), k)})


TABLES = Tables()


def plain(name: str) -> str:
    """Small letters without accents."""
    s = "".join(c for c in unicodedata.normalize("NFD", name.casefold()) if not unicodedata.combining(c))
    return s.replace("ø", "o").replace("ß", "ss").replace("æ", "ae").replace("ł", "l").replace("đ", "d")


def _letters(s: str) -> str:
    """The letters of any script."""
    return "".join(c for c in s if c.isalpha())


def _is_initials(token: str, shouted: bool) -> bool:
    bare = token.replace(".", "").replace("-", "")
    if "." in token or len(bare) == 1:
        return len(bare) <= 4 and bare.isalpha() and (token.count(".") >= len(bare) or len(bare) == 1)
    return bare.isupper() and len(bare) <= 3 and (not shouted or not re.search("[AEIOUYaeiouy]", plain(bare)))


def author_rewritings(name: str, tables: Tables = TABLES) -> list[tuple[str, str, str, str, int]]:
    """(surname, given name, first initial, middle initial, cost): the ways to read a person's name, sure ones at cost 0."""
    raw = re.sub(r"\s+", " ", name.replace("’", "'")).strip(" ,;")
    shouted = raw.isupper()
    comma = "," in raw
    if comma:
        family, _, rest = raw.partition(",")
        sides = [(family.split(), re.sub(r"\.(?=\S)", ". ", rest).split(), 0)]
    else:
        tokens = [t for t in re.sub(r"\.(?=\w)", ". ", raw).split() if plain(t).strip(".") not in tables.titles]
        marks = [_is_initials(t, shouted) for t in tokens]
        if len(tokens) < 2:
            sides = [(tokens, [], 0)]
        elif marks[-1] and not marks[0]:
            k = next(i for i, m in enumerate(marks) if m)
            head = tokens[:k]
            # "Adams Anna B.": the initial is a middle one, the order of the rest is open
            sides = _orders(head, tokens[k:], tables) if len(head) > 1 and plain(head[0]) not in tables.particles else [(head, tokens[k:], 0)]
        elif marks[0]:
            k = next((i for i, m in enumerate(marks) if not m), len(tokens) - 1)
            sides = [(tokens[k:], tokens[:k], 0)]
        else:
            sides = _orders(tokens, [], tables)
    out = []
    for family, given, cost in sides:
        while len(given) > 1 and plain(given[-1]) in tables.particles:
            family, given = [given[-1], *family], given[:-1]
        s = _letters(plain(" ".join(family)))
        names = [t for t in given if plain(t).strip(".") not in tables.titles]
        first = names[0] if names else ""
        if first and _is_initials(first, False if not shouted else shouted):
            letters = _letters(plain("".join(t for t in names if _is_initials(t, shouted))))
            g, i, m = "", letters[:1], letters[1:2]
        else:
            g = _letters(plain(first))
            g = tables.given.get(g, g)
            i, m = g[:1], _letters(plain(names[1]))[:1] if len(names) > 1 else ""
        if s:
            out.append((s, g, i, m, cost))
    return out


def _orders(tokens: list[str], middle: list[str], tables: Tables) -> list[tuple[list[str], list[str], int]]:
    """Both orders of given name and surname; particles stay with the surname."""
    low = [plain(t) for t in tokens]
    at = next((i for i, t in enumerate(low) if t in tables.particles or t.startswith("al-")), None)
    if at == 0:
        k = next((i for i, t in enumerate(low) if t not in tables.particles), len(tokens) - 1)
        return [(tokens[: k + 1], tokens[k + 1 :] + middle, 0)]
    if at is not None:
        return [(tokens[at:], tokens[:at] + middle, 0)]
    inner = [t for t in tokens[1:-1]]
    return [(tokens[-1:], tokens[:1] + inner + middle, 1), (tokens[:1], tokens[1:] + middle, 2)]


def one_typing_error(a: str, b: str) -> bool:
    """Whether one letter more, less or other, or two neighbours swapped, make ``a`` of ``b``."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _kind_of(token: str, tables: Tables) -> str | None:
    found = tables.kind.get(token)
    if found is None and len(token) >= 5:
        found = next((k for w, k in tables.kind.items() if len(w) >= 6 and abs(len(w) - len(token)) <= 1 and one_typing_error(token, w)), None)
    return found


def institution_rewriting(name: str, tables: Tables = TABLES) -> tuple[str, str]:
    """(kinds, core): the sorted words of its legal form, and what is left; departments are off."""
    parts = [p.strip() for p in plain(name).split(",") if p.strip()]
    while len(parts) > 1 and re.match(r"(dept|department|school|faculty|div|division|unit)\b", parts[0]):
        parts.pop(0)
    tokens = [t for t in re.findall(r"[^\W_]+", " ".join(parts)) if t not in tables.small_words]
    kinds = [_kind_of(t, tables) for t in tokens]
    core = [t for t, k in zip(tokens, kinds, strict=True) if k is None]
    if not core:
        return "", " ".join(tokens)
    return " ".join(sorted({k for k in kinds if k})), " ".join(sorted(core))


def journal_rewriting(name: str, tables: Tables = TABLES) -> tuple[str, list[str]]:
    """(series, words): the letter of its part or section, and its words."""
    text = re.sub(r"\((?:online|print)\)|\[electronic resource\]", " ", plain(name))
    series = ""
    found = re.search(r"\b(?:part|section|series|sect|ser)\W+([a-z0-9]{1,3})\W*$", text)
    if found:
        series, text = found.group(1), text[: found.start()]
    tokens = re.findall(r"[^\W_]+", text)
    return series, [tables.journal_words.get(t, t) for t in tokens if len(t) > 2 or not t.isascii() or t in tables.journal_words or t in tables.small_words]


def _near(a: Column, b: Column) -> Column:
    """:func:`one_typing_error` as an expression; a swap is two replacements with the same letters."""
    swap = (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (F.levenshtein(a, b) <= 1) | swap | (_without_umlauts(a) == _without_umlauts(b))


def _without_umlauts(c: Column) -> Column:
    """oe, ae and ue as the letters they may stand for."""
    return F.regexp_replace(c, "([oau])e", "$1")


def repaired(words: DataFrame, ratio: float, shortest: int | Column, rare: int | Column = 0) -> DataFrame:
    """(kind, word, fixed, score, n): words that are one typing error from a more frequent word of their kind.

    ``words`` is (kind, word, n). A word is replaced by the most frequent word that shares a rewriting with one letter left
    out, if that one is ``ratio`` times as frequent, or at least as frequent and the word stands in ``rare`` names at most;
    ``shortest`` and ``rare`` may depend on the kind. The distinct words of a rewriting are those with one letter put in, so there are never more of them than letters times places.
    """
    long = words.where(F.length("word") >= shortest)
    gaps = F.concat(F.array(F.col("word")), F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word")))))
    keyed = long.select("kind", "word", "n", F.explode(F.array_distinct(F.concat(gaps, F.array(_without_umlauts(F.col("word")))))).alias("_key"))
    # both sides are named alike, so that they share one shuffle; the planner takes the exploded rows for as few as the words, and would
    # send them through the driver
    side = lambda word, n: keyed.select("kind", "_key", F.col("word").alias(word), F.col("n").alias(n))
    ok = (F.col("_m") >= F.col("_n") * ratio) | ((F.col("_n") <= rare) & (F.struct(F.col("_n"), F.col("_v")) < F.struct(F.col("_m"), F.col("_w"))))
    met = side("_v", "_n").join(side("_w", "_m").hint("merge"), ["kind", "_key"]).where(F.col("_w") != F.col("_v")).where(ok).where(_near(F.col("_v"), F.col("_w")))
    found = met.groupBy("kind", F.col("_v").alias("word")).agg(F.max(F.struct("_m", "_w")).alias("_b"), F.countDistinct("_w").alias("_k"), F.max("_n").alias("n"))
    return written(found.select("kind", "word", F.col("_b._w").alias("fixed"), (1.0 / F.col("_k")).alias("score"), "n"), "fixes")


def _fix(df: DataFrame, kind: Column, word: str, fixes: DataFrame) -> DataFrame:
    """``df`` with the word replaced where it has a fix, by which the score is multiplied."""
    table = fixes.select(F.col("kind").alias("_kind"), F.col("word").alias(word), F.col("fixed").alias("_fixed"), F.col("score").alias("_by"), F.col("n").alias("_rows"))
    joined = looked_up(df.withColumn("_kind", kind), table, ["_kind", word], "_rows", few=FEW)
    return joined.withColumns({word: F.coalesce("_fixed", word), "score": F.col("score") * F.coalesce("_by", F.lit(1.0))}).drop("_kind", "_fixed", "_by")


def contracted(words: DataFrame) -> DataFrame:
    """(kind, word, fixed, score, n): words with two consonants after their first letter, such as jrnl, by the word that they contract.

    A word is contracted if letters between its first and last one are left out of a word 8 times as frequent; the most frequent
    such word counts if it is 3 times as frequent as any other.
    """
    ends = F.concat(F.substring("word", 1, 1), F.substring("word", -1, 1))
    short = words.where(F.col("word").rlike("^[a-z][b-df-hj-np-tv-z]{2}")).select("kind", F.col("word").alias("short"), F.col("n").alias("_ns"), ends.alias("_e"))
    long = words.where(F.col("word").rlike("[aeiou]")).select("kind", "word", "n", ends.alias("_e"))
    left_out = F.levenshtein("short", "word") == F.length("word") - F.length("short")
    met = short.join(broadcast_if_small(long, FEW), ["kind", "_e"]).where((F.length("word") > F.length("short")) & (F.col("n") >= 8 * F.col("_ns")) & left_out)
    best = met.groupBy("kind", "short").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "word")), asc=False), 1, 2).alias("_b"), F.count("*").alias("_k"), F.max("_ns").alias("n"))
    sure = (F.size("_b") == 1) | (F.col("_b")[0]["n"] >= 3 * F.try_element_at("_b", F.lit(2))["n"])
    return written(best.where(sure).select("kind", F.col("short").alias("word"), F.col("_b")[0]["word"].alias("fixed"), (1.0 / F.col("_k")).alias("score"), "n"), "contractions")


def _without_countries(names: DataFrame) -> DataFrame:
    """``names`` with a country that ends an institution's name cut off; countries are all values of the country column."""
    low = lambda c: F.trim(F.regexp_replace(clean.without_accents(F.lower(c)), "^[ .]+|[ .]+$", ""))
    known = names.where("country is not null").select(low(F.col("country")).alias("_last")).where("_last <> ''").distinct().withColumn("_is", F.lit(True))
    last = F.when((F.col("field_name") == "institution") & F.col("name").contains(","), low(F.substring_index("name", ",", -1)))
    tried = names.withColumn("_last", last).join(broadcast_if_small(written(known, "known"), FEW), "_last", "left")
    return tried.withColumn("name", F.when(F.col("_is"), F.regexp_replace("name", ",[^,]*$", "")).otherwise(F.col("name"))).select(names.columns)


def _rewritten(names: DataFrame, tables: Tables) -> DataFrame:
    """One row for each reading of each name, parsed in Arrow batches."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in it:
            rows = []
            for k, f, name, country in zip(d["name_id"], d["field_name"], d["name"], d["country"], strict=True):
                if f == "author":
                    rows += [(k, f, country, "", s, g, i, m, cost, None) for s, g, i, m, cost in author_rewritings(name, tables)]
                elif f == "institution":
                    kinds, core = institution_rewriting(name, tables)
                    rows.append((k, f, country, kinds, core, "", "", "", 0, None))
                else:
                    series, words = journal_rewriting(name, tables)
                    rows.append((k, f, country, series, "", "", "", "", 0, words))
            yield pd.DataFrame(rows, columns=["name_id", "field_name", "country", "cls", "s", "g", "i", "m", "cost", "words"])

    kind = names.schema["name_id"].dataType.simpleString()
    parsed = names.select("name_id", "field_name", "name", "country").mapInPandas(run, f"name_id {kind}, field_name string, country string, cls string, s string, g string, i string, m string, cost int, words array<string>")
    return parsed.withColumn("score", F.lit(1.0))


def _nicknamed(read: DataFrame, tables: Tables) -> DataFrame:
    """``read`` with nicknames of several names replaced where a single one of them stands with the surname."""
    if not tables.several:
        return read
    pairs = [(n, g) for n, gs in tables.several.items() for g in gs]
    table = F.broadcast(read.sparkSession.createDataFrame(pairs, "nick string, g string"))  # as long as the caller's table
    full = read.where("g <> ''").select("s", "g").distinct()
    forms = full.join(table, "g").select("s", F.col("g").alias("_full"), F.col("nick").alias("g"))
    one = forms.groupBy("s", "g").agg(F.min("_full").alias("_full"), F.count("*").alias("_k")).where("_k = 1").join(full, ["s", "g"], "left_semi")
    return read.join(broadcast_if_small(written(one.drop("_k"), "nicknamed"), FEW), ["s", "g"], "left").withColumn("g", F.coalesce("_full", "g")).drop("_full")


def _ordered(rows: DataFrame, counted: DataFrame, fixes: DataFrame) -> DataFrame:
    """One reading of each person's name, given names repaired: of the two orders the one whose given name is the more usual one."""
    named = _fix(rows.where("g <> ''"), F.lit("given"), "g", fixes)
    usual = counted.where("kind = 'given' and n > 0").select(F.col("word").alias("g"), F.col("n").alias("_gn"))
    # names of initials only do not pass the join
    weighed = looked_up(named, usual, ["g"], "_gn", keep="_gn", few=FEW).withColumn("_gn", F.coalesce("_gn", F.lit(0))).unionByName(rows.where("g = ''").withColumn("_gn", F.lit(0).cast("bigint")))
    return weighed.groupBy("name_id").agg(F.max_by(F.struct("s", "g", F.when(F.col("g") != "", F.substring("g", 1, 1)).otherwise(F.col("i")).alias("i"), "m", "country", "score"), F.struct("_gn", -F.col("cost"), "s")).alias("_r")).select("name_id", "_r.*")


def _respelled(people: DataFrame, schools: DataFrame) -> DataFrame:
    """(field_name, kind and the columns of ``people``): surnames repaired among those of one initial, institutions' cores among those of one legal form.

    Both are repaired by the same rule and in one table, so that there are half as many plans.
    """
    people = people.select(F.lit("author").alias("field_name"), F.when(F.col("i") != "", F.concat(F.lit("author|"), "i")).alias("kind"), *people.columns)
    none = [F.lit(None).cast(people.schema[c].dataType).alias(c) for c in ("g", "i", "m", "country")]
    read = people.unionByName(schools.select(F.lit("institution").alias("field_name"), F.concat(F.lit("institution|"), "cls").alias("kind"), "name_id", "s", *none, "score"))
    for _ in range(2):
        read = written(read, "read")
        words = read.where("kind is not null").groupBy("kind", F.col("s").alias("word")).agg(F.count("*").alias("n"))
        read = _fix(read, F.col("kind"), "s", repaired(words, 3.0, 6, rare=2))
    return written(read, "read")


def _authors(read: DataFrame, tables: Tables) -> DataFrame:
    """(name_id, entity, score) of persons, one reading each."""
    read = written(_nicknamed(read, tables).withColumn("i", F.when(F.col("g") != "", F.substring("g", 1, 1)).otherwise(F.col("i"))), "read")
    full = read.where("g <> ''")

    def only(keys: list[str], n: int) -> DataFrame:
        """For each key with a full name: how many given names, the first one, and the ends of their countries and middle initials."""
        there = full.where(" and ".join(f"{k} is not null and {k} <> ''" for k in keys))
        middle = F.nullif(F.col("m"), F.lit(""))
        return there.groupBy(*keys).agg(
            F.countDistinct("g").alias(f"_k{n}"), F.min("g").alias(f"_g{n}"), F.min("country").alias(f"_c{n}"), F.max("country").alias(f"_d{n}"), F.min(middle).alias(f"_m{n}"), F.max(middle).alias(f"_n{n}")
        )

    short = read.where("g = ''").drop("g").join(only(["s", "i"], 1), ["s", "i"], "left").join(only(["s", "i", "m"], 2), ["s", "i", "m"], "left").join(only(["s", "i", "country"], 3), ["s", "i", "country"], "left")
    agrees = lambda own, low, high, known: F.coalesce(own == "", F.lit(True)) | low.isNull() | F.when(low == high, own == low).otherwise(known.isNotNull())
    c = F.col
    fits = agrees(c("country"), c("_c1"), c("_d1"), c("_k3")) & agrees(c("m"), c("_m1"), c("_n1"), c("_k2"))
    g = (
        F.when((c("_k1") == 1) & fits, c("_g1"))
        .when((c("_k1") > 1) & (c("_k2") == 1), c("_g2"))
        .when((c("_k1") > 1) & (c("_k3") == 1) & agrees(c("m"), c("_m3"), c("_n3"), F.lit(None)), c("_g3"))
    )
    solved = written(short.withColumn("_g", g), "solved")
    unknown = F.when(c("_k1").isNull(), F.concat_ws("|", F.lit("initials"), "s", "i")).when(c("_k1") == 1, F.concat_ws("|", F.lit("initials"), "s", "i", F.coalesce("country", F.lit("")), "m"))
    alone = F.concat(F.lit("name|"), F.col("name_id").cast("string"))
    left = solved.where("_g is null").select("name_id", F.coalesce(unknown, alone).alias("entity"), (c("score") / F.coalesce("_k1", F.lit(1))).alias("score"))
    told = solved.where("_g is not null").select("name_id", "s", c("_g").alias("g"), "m", "country", (c("score") / c("_k1")).alias("score"))
    return _told_apart(full.select("name_id", "s", "g", "m", "country", "score").unionByName(told)).unionByName(left)


def _told_apart(people: DataFrame) -> DataFrame:
    """(name_id, entity, score): people of one surname and given name by country, then by middle initial, where several are known.

    A name without a country belongs to the only country of its middle initial; one that nothing decides stays alone.
    """
    people = written(people, "people")
    middle = F.nullif(F.col("m"), F.lit(""))
    lands = people.groupBy("s", "g").agg(F.min("country").alias("_c"), F.max("country").alias("_d"))
    by_middle = people.where("m <> ''").groupBy("s", "g", "m").agg(F.min("country").alias("_cm"), F.max("country").alias("_dm"))
    several = lands.where("_c <> _d").select("s", "g", F.lit(True).alias("_several"))
    placed = people.join(broadcast_if_small(written(several, "several"), FEW), ["s", "g"], "left")
    apart = placed.where("_several").join(by_middle, ["s", "g", "m"], "left").withColumn("_land", F.coalesce("country", F.when(F.col("_cm") == F.col("_dm"), F.col("_cm"))))
    rows = placed.where("_several is null").withColumn("_land", F.lit("")).select("name_id", "s", "g", "m", "score", "_land").unionByName(apart.select("name_id", "s", "g", "m", "score", "_land"))
    rows = written(rows, "placed")
    middles = rows.where("_land is not null").groupBy("s", "g", "_land").agg(F.min(middle).alias("_m"), F.max(middle).alias("_n")).where("_m <> _n").select("s", "g", "_land", F.lit(True).alias("_many"))
    told = rows.join(broadcast_if_small(written(middles, "middles"), FEW), ["s", "g", "_land"], "left")
    who = F.when(F.col("_land").isNotNull() & (F.col("_many").isNull() | (F.col("m") != "")), F.concat_ws("|", F.lit("person"), "s", "g", "_land", F.when(F.col("_many"), F.col("m")).otherwise("")))
    return told.select("name_id", F.coalesce(who, F.concat(F.lit("name|"), F.col("name_id").cast("string"))).alias("entity"), "score")


def _title_words(rows: DataFrame) -> DataFrame:
    return rows.select("name_id", "cls", "country", "score", F.explode("words").alias("w"))


def _journals(rows: DataFrame, counted: DataFrame, fixes: DataFrame, tables: Tables) -> DataFrame:
    """(name_id, entity, score) of journals: words repaired, abbreviated titles joined to the full one they abbreviate.

    A word of a title is abbreviated by its beginning, or by leaving out letters between its first and last one.
    """
    words = _title_words(rows)
    kind = F.lit("journal")
    # small words go, and with them those in which a letter was typed twice, an eighth as frequent or less
    small = counted.where(F.col("word").isin(*tables.small_words))
    twice = counted.select(F.col("word").alias("w"), F.col("n").alias("_n"), F.regexp_replace("word", "(.)\\1", "$1").alias("word")).join(F.broadcast(small), "word").where((F.col("w") != F.col("word")) & (F.col("_n") * 8 <= F.col("n")))  # as many rows as the table has small words
    words = words.where(~F.col("w").isin(*tables.small_words)).join(broadcast_if_small(written(twice.select("w"), "twice"), FEW), "w", "left_anti")
    fixed = written(_fix(_fix(words, kind, "w", fixes), kind, "w", contracted(counted)), "words")
    start = F.substring("w", 1, 3)
    titles = fixed.groupBy("name_id", "cls", "country").agg(F.array_sort(F.collect_list("w")).alias("t"), F.array_join(F.array_sort(F.collect_list(start)), " ").alias("_key"), F.min("score").alias("score"))
    forms = written(titles.groupBy("cls", "_key", "t").agg(F.min("country").alias("_c")).withColumn("_len", F.length(F.array_join("t", ""))), "titles")
    small, big = forms.select("cls", "_key", F.col("t").alias("t"), "_len"), forms.select("cls", "_key", F.col("t").alias("_big"), F.col("_len").alias("_blen"), F.col("_c").alias("_bc"))
    left_out = lambda a, b: (F.substring(a, -1, 1) == F.substring(b, -1, 1)) & (F.levenshtein(a, b) == F.abs(F.length(a) - F.length(b)))
    fits = (F.size("t") == F.size("_big")) & F.forall(F.zip_with("t", "_big", lambda a, b: a.startswith(b) | b.startswith(a) | left_out(a, b)), lambda x: x)
    # the meeting of titles that agree in the starts of all their words, each distinct title once
    met = written(split_join(small, big, ["cls", "_key"]).where((F.col("_blen") > F.col("_len")) & fits), "met")
    tops = written(met.join(met.select("cls", "_key", F.col("t").alias("_big")).distinct(), ["cls", "_key", "_big"], "left_anti"), "tops")
    one = tops.groupBy("cls", "_key", "t").agg(F.count("*").alias("_n"), F.min("_big").alias("_only"))
    there = tops.where("_bc is not null").groupBy("cls", "_key", "t", F.col("_bc").alias("country")).agg(F.count("*").alias("_nc"), F.min("_big").alias("_onlyc"))
    found = titles.join(broadcast_if_small(one, FEW), ["cls", "_key", "t"], "left").join(broadcast_if_small(there, FEW), ["cls", "_key", "t", "country"], "left")
    title = F.when(F.col("_n") == 1, F.col("_only")).when(F.col("_nc") == 1, F.col("_onlyc")).otherwise(F.col("t"))
    return found.select("name_id", F.concat_ws("|", F.lit("journal"), "cls", F.array_join(title, " ")).alias("entity"), (F.col("score") / F.coalesce("_n", F.lit(1))).alias("score"))


def entities(forms: DataFrame, tables: Tables = TABLES) -> DataFrame:
    """(name_id, field_name, entity, score): the entity of each name; names with the same entity are spellings of one.

    The score is the rarity of the rewriting that led there: one over the number of full names, words and titles it may stand for.
    Defined results: missing names and null ids and fields give no row; repeated rows count once; a null country agrees
    with any; initials that fit several full names and nothing decides stay alone; fields other than author and institution are
    read as titles; names of any script are read, and those without a word that counts agree if they are the same text; an empty table
    gives no row; other columns are not read.
    """
    names = forms.select("name_id", "field_name", clean.squeezed(F.col("name")).alias("name"), clean.present(F.col("country")).alias("country")).where("name_id is not null and field_name is not null").where(~clean.is_missing(F.col("name"))).distinct()
    rows = written(_rewritten(_without_countries(names), tables), "rewritings")
    persons, titled = rows.where("field_name = 'author'"), rows.where("field_name not in ('author', 'institution')")
    given = persons.where("g <> ''").groupBy(F.col("g").alias("word")).agg(F.count_if(F.col("cost") == 0).alias("n")).select(F.lit("given").alias("kind"), "word", "n")
    counted = written(given.unionByName(_title_words(titled).groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n")).select(F.lit("journal").alias("kind"), "word", "n")), "counted")
    is_given = F.col("kind") == "given"
    fixes = repaired(counted, 8.0, F.when(is_given, 2).otherwise(5), rare=F.when(is_given, 0).otherwise(2))
    read = _respelled(_ordered(persons, counted, fixes), rows.where("field_name = 'institution'"))
    # each field by itself: a plan of all of them would be made anew at each of its stages
    authors = written(_authors(read.where("field_name = 'author'").drop("field_name", "kind"), tables), "authors").withColumn("field_name", F.lit("author"))
    institutions = read.where("field_name = 'institution'").select("name_id", F.concat(F.col("kind"), F.lit("|"), F.col("s")).alias("entity"), "score", "field_name")
    journals = written(_journals(titled, counted.where("kind = 'journal'"), fixes, tables), "journals").join(titled.select("name_id", "field_name").distinct(), "name_id")
    found = authors.unionByName(institutions.where("entity <> 'institution||'")).unionByName(journals)
    found = written(found.select("name_id", "field_name", "entity", "score"), "found")
    # names of which the rules read nothing, such as numbers, agree if they are the same text
    left = names.join(found.select("name_id", "field_name").distinct(), ["name_id", "field_name"], "left_anti")
    found = found.unionByName(left.select("name_id", "field_name", F.concat(F.lit("text|"), F.lower("name")).alias("entity"), F.lit(1.0).alias("score")))
    return found.groupBy("name_id", "field_name", F.concat_ws("|", "field_name", "entity").alias("entity")).agg(F.max("score").alias("score"))


def linked(forms: DataFrame, tables: Tables = TABLES) -> DataFrame:
    """(name_id_a, name_id_b), a < b: every pair of names of one field that mean the same entity, from the membership in :func:`entities`.

    For reports of pairs; an entity with very many names is paired block by block, in many tasks.
    """
    found = written(entities(forms, tables).select("name_id", "entity"), "entities")
    return split_join(found.toDF("name_id_a", "entity"), found.toDF("name_id_b", "entity"), ["entity"]).where("name_id_a < name_id_b").select("name_id_a", "name_id_b").distinct()
