import collections
import datetime as dt
import itertools
import os
import time

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillmill.llm import co_items, format_twins, languages, names, packing, queries, survivors, tokens
from quillmill.llm import merge_automaton
from quillmill.llm.merge_automaton import MergeAutomaton, Vocabulary, emitted, read_vocabulary
from tests.conftest import rows
from tests.parity import connect, same

HAVE = os.path.exists(queries.VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not HAVE, reason="no vocabulary file")


# 1 survivors -------------------------------------------------------------------------------------


def _corpus(spark, records):
    cols = "record_id long, source string, updated_at timestamp, abstract string, references string, doi string, pos string"
    return spark.createDataFrame([(k, s, t, a, r, d, "x") for k, s, t, a, r, d in records], cols)


def test_survivors(spark):
    t = lambda d: dt.datetime(2020, 1, d)
    records = _corpus(spark, [
        (1, " SCOPUS ", t(1), "A study of X and", "R1; R2", "https://doi.org/10.1/ab"),
        (2, "wos", t(2), "A study of X and Y.", "R1; R2; R3", "10.1/abc"),
        (3, "wos", t(3), "A study of X and Y.", "R4", "10.1"),
        (4, None, None, "No abstract available", "n/a", None),
        (5, "wos", None, "Other text", "1. R1\n2. R2", "10.1/ABC"),
        (6, "scopus", t(9), "alone", None, "x"),
    ])
    groups = spark.createDataFrame([(1, k) for k in range(1, 6)] + [(1, 2), (2, 6), (3, 99), (None, 1)], "group_id long, record_id long")
    sources = spark.createDataFrame([("scopus", "scopus", 1), ("wos", "wos", 2)], "source string, label string, trust_rank int")
    want = [(1, "abstract", 3), (1, "doi", 2), (1, "references", 3), (2, "abstract", 6)]
    assert rows(survivors.best_records(groups, records, sources)) == want
    built = {r["group_id"]: r for r in survivors.survivors(groups, records, sources).collect()}
    assert built[1]["abstract"] == "A study of X and Y." and built[1]["source"] == "wos" and built[2]["doi"] is None
    assert survivors.best_records(groups.limit(0), records, sources).count() == 0


def test_trust_comes_before_time_and_numbers(spark):
    t = lambda d: dt.datetime(2020, 1, d)
    old = dt.datetime(1950, 1, 1)
    records = _corpus(spark, [
        (1, "first", None, "from the best source", None, "10.1/a"), (2, "second", t(9), "from the newest record", None, "10.1/b"), (3, "second", t(9), "from the newest record", None, "10.1/b"),
        (4, "first", old, None, None, "10.1/c"), *((k, "third", t(9), "from the newest record", None, "10.1/b") for k in range(10, 60)),
        (5, "first", t(3).replace(hour=1), "x y", "R1", None), (6, "first", t(3).replace(hour=2), "z", "R2", None), (7, "first", t(3).replace(hour=1), "x y", "R1", None),
    ])
    groups = spark.createDataFrame([(1, k) for k in (1, 2, 3, 4, *range(10, 60))] + [(2, k) for k in (5, 6, 7)], "group_id long, record_id long")
    sources = spark.createDataFrame([("a", "first", 1), ("b", "second", 2), ("c", "third", 3)], "source string, label string, trust_rank int")
    assert rows(survivors.best_records(groups, records, sources)) == [(1, "abstract", 1), (1, "doi", 4), (2, "abstract", 6), (2, "references", 6)]
    # with agreement many votes win, though each is less
    assert rows(survivors.best_records(groups, records, sources, agreement=True)) == [(1, "abstract", 2), (1, "doi", 2), (2, "abstract", 5), (2, "references", 5)]


@pytest.mark.parametrize("seed", range(3))
def test_the_sum_gives_the_rule(spark, seed):
    rng = np.random.default_rng(seed)
    labels = ["s1", "s2", "s3", None, "odd"]
    data = [(k, labels[int(rng.integers(5))], None if rng.random() < 0.2 else dt.datetime(2020, 1, int(rng.integers(1, 4)), int(rng.integers(0, 3))), None, None, f"10.1/{'abc'[int(rng.integers(3))]}x") for k in range(80)]
    groups = spark.createDataFrame([(k % 7, k) for k in range(80)], "group_id long, record_id long")
    sources = spark.createDataFrame([("x", f"s{r}", r) for r in (1, 2, 3)], "source string, label string, trust_rank int")
    rank = lambda s: int(s[1]) if s and s[0] == "s" else 99
    best = lambda g: min((r for r in data if r[0] % 7 == g), key=lambda r: (rank(r[1]), -(r[2].timestamp() if r[2] else 0), r[0]))
    assert rows(survivors.best_records(groups, _corpus(spark, data), sources)) == [(g, "doi", best(g)[0]) for g in range(7)]


def test_beginnings_against_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab"), int(rng.integers(1, 9)))) for _ in range(300)]
    values = spark.createDataFrame([(k % 2, "abstract", t, t) for k, t in enumerate(texts)], "group_id long, field_name string, norm string, t string").distinct()
    groups = collections.defaultdict(set)
    for k, t in enumerate(texts):
        groups[k % 2].add(t)
    for parts in ("1", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {(r["group_id"], r["t"]): r["_part"] for r in survivors.begins_another(values).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == {(g, t): any(o != t and o.startswith(t) for o in ts) for g, ts in groups.items() for t in ts}


def test_subsets_against_brute_force(spark):
    rng = np.random.default_rng(2)
    sets = sorted({tuple(sorted(set(rng.choice(list("abcdefg"), int(rng.integers(1, 6))).tolist()))) for _ in range(40)})
    df = spark.createDataFrame([(k % 3, "references", "\n".join(s), k, k) for k, s in enumerate(sets)], "group_id long, field_name string, norm string, _h long, _g long")
    got = {r["_h"]: r["_part"] for r in survivors.within_another(df).collect()}
    for k, s in enumerate(sets):
        assert got[k] == any(set(s) < set(o) for j, o in enumerate(sets) if j % 3 == k % 3)


# 3 names -----------------------------------------------------------------------------------------


def test_names(spark):
    spellings = {
        "person": ["Peiklossen, Giuseppe", "Giuseppe Peiklossen", "Peiklossen, G.", "PEIKLOSSEN, GIUSEPPE", "Peiklossen, Beppe", "Peikolssen, Giuseppe", "Dr Giuseppe R. Peiklossen", "Peiklossen GR"],
        "other": ["Peiklossen, Anna", "A. Peiklossen"],
        "school": ["University of Hagretrumann", "Hagretrumann Univ.", "Dept. of Physics, Universität Hagretrumann, France", "univeristy of hagretrumann", "U. of Hagretruman"],
        "state": ["Hagretrumann State University", "Hagretrumann St Univ"],
        "journal": ["Annals of Balkan Organic Chemistry", "ANN BALKAN ORGA CHEMIS", "Balkan Organic Chemistry, Annals of", "Annals of Balkan Organic Chemistry (Online)"],
        "part": ["Annals of Balkan Organic Chemistry, Part B", "Ann. Balkan Orga. Chem. - Section B"],
    }
    field = {"person": "author", "other": "author", "school": "institution", "state": "institution", "journal": "journal", "part": "journal"}
    forms, truth = [], {}
    for e, spelled in spellings.items():
        for s in spelled:
            truth[len(forms)] = e
            forms.append((len(forms), field[e], s, "France", "x"))
    forms += [(900, "author", None, None, "x"), (901, "author", "n/a", None, "x"), forms[0]]
    df = spark.createDataFrame(forms, "name_id long, field_name string, name string, country string, entity string")
    want = {(a, b) for a, b in itertools.combinations(truth, 2) if truth[a] == truth[b]}
    assert {tuple(r) for r in names.linked(df).collect()} == want
    assert names.linked(df.limit(0)).count() == 0


def test_initials_that_fit_two(spark):
    df = spark.createDataFrame([(1, "author", "Brandt, Anna", "France"), (2, "author", "Brandt, Alexander", "Spain"), (3, "author", "Brandt, A.", None), (4, "author", "Brandt, A.", "Spain")], "name_id long, field_name string, name string, country string")
    assert rows(names.linked(df)) == [(2, 4)]


def _entity_sets(spark, forms):
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(forms)], "name_id long, field_name string, name string, country string")
    found = collections.defaultdict(set)
    for r in names.entities(df).collect():
        assert 0 < r["score"] <= 1
        found[r["entity"]].add(r["name_id"])
    return sorted(sorted(x) for x in found.values())


def test_nicknames_of_the_table(spark):
    forms = [("author", n, "France") for n in ("Brandt, Andrew", "Andy Brandt", "Holm, Charles", "Holm, Charlie", "Roe, Steven", "Roe, Steve", "Poe, William", "Poe, Bill", "Lund, Pat", "Lund, Patricia", "Ek, Pat", "Ek, Patricia", "Ek, Patrick")]
    assert _entity_sets(spark, forms) == [[0, 1], [2, 3], [4, 5], [6, 7], [8, 9], [10], [11], [12]]
    own = names.Tables(nicknames={"zebedee": "zeb"})
    df = spark.createDataFrame([(1, "author", "Roe, Zeb", None), (2, "author", "Roe, Zebedee", None), (3, "author", "Poe, Bill", None), (4, "author", "Poe, William", None)], "name_id long, field_name string, name string, country string")
    assert rows(names.linked(df, own)) == [(1, 2)] and rows(names.linked(df)) == [(3, 4)]


def test_people_of_one_name(spark):
    forms = [("author", n, c) for n, c in (
        ("Wang, Wei M.", "China"), ("Wang, Wei J.", "China"), ("Wei M. Wang", None), ("Wang, Wei", "China"), ("Wang, W. J.", "China"),
        ("Meier, Anna", "Germany"), ("Meier, Anna", "Austria"), ("Meier, A.", "Austria"), ("Meier, A.", "Spain"), ("Anna Meier", None), ("Sole, Rosa B.", "Spain"), ("Sole, Rosa", "Spain"), ("Sole, R. B.", None),
    )]
    # a name that nothing decides stays alone
    assert _entity_sets(spark, forms) == [[0, 2], [1, 4], [3], [5], [6, 7], [8], [9], [10, 11, 12]]


def test_words_of_titles_and_places(spark):
    forms = [("journal", n, "France") for n in ("Advances in Marine Optics", "Advncs in Marine Optics", "Procs. of Alpine Botany", "Proceedings of Alpine Botany", "Advances in Marine oof Optics")]
    forms += [("institution", n, c) for n, c in (("University of Tarmo", "Noland"), ("University of Tarmo, Noland", None), ("University of Tarmo, Elsewhere", "Noland"))]
    forms += [("journal", f"Annals of Field {'ABCDEFGH'[k]}{'xyzuvwst'[k] * 4}", None) for k in range(8)]
    assert _entity_sets(spark, forms)[:4] == [[0, 1, 4], [2, 3], [5, 6], [7]]


def test_names_of_any_script(spark):
    forms = [("author", n, None) for n in ("王伟", "王伟", "王芳", "Иванов, Пётр", "Пётр Иванов", "...", "...", "!")]
    forms += [("institution", n, None) for n in ("北京大学", "北京大学", "清华大学", "Κέντρο Ερευνών", "???", "2001")]
    forms += [("journal", n, None) for n in ("Of the", "Of the", "化学", "化学", "数学")]
    assert _entity_sets(spark, forms) == [[0, 1], [2], [3, 4], [5, 6], [7], [8, 9], [10], [11], [12], [13], [14, 15], [16, 17], [18]]


def test_an_entity_of_many_names(spark, monkeypatch):
    from quillmill.plans import split_join

    monkeypatch.setattr(split_join, "__defaults__", (10,))
    df = spark.createDataFrame([(k, "author", "Roe, Anna", "France") for k in range(40)] + [(99, "author", "Poe, Anna", "France")], "name_id long, field_name string, name string, country string")
    assert rows(names.linked(df)) == sorted([(a, b) for a in range(40) for b in range(a + 1, 40)], key=repr)


def _odd_names(spark):
    forms = [("author", n, c) for n, c in (("Peiklossen, Giuseppe", "France"), ("Beppe Peiklossen", None), ("Peikolssen, G.", "France"), ("Peiklossen, Giusepe M.", "Spain"), ("Wang, Wei M.", "China"), ("Wei J. Wang", "China"), ("Wang, W. J.", None), ("Lund, Pat", None), ("Lund, Patricia", None), ("Roe", None), ("...", None))]
    forms += [("institution", n, "France") for n in ("University of Hagretrumann", "Hagretruman Univ.", "Univ Hagretrumann, France", "University of", "2001")]
    forms += [("journal", n, None) for n in ("Advances in Marine Optics", "Advncs in Marine Optics", "ADV MAR OPT", "Marine Optics, Advnaces in", "Advances in Marine oof Optics")]
    forms += [("journal", f"Advances in Field {x * 4}", None) for x in "xyzuvwstpq"] + [("author", f"{x * 3}el, Giuseppe", None) for x in "bcdfghkl"]
    return spark.createDataFrame([(k, *x) for k, x in enumerate(forms)], "name_id long, field_name string, name string, country string")


def test_words_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    words = spark.createDataFrame([("given", f"word{k}", k) for k in range(50)], "kind string, word string, n long")
    words.write.parquet(str(tmp_path / "words"))
    monkeypatch.setattr(names, "written", lambda df, name="table": df)
    plan = names.repaired(spark.read.parquet(str(tmp_path / "words")), 3.0, 2, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_plans_of_names_stay_small(spark, monkeypatch):
    joins = []

    def written(df, name="table", write=names.written):
        joins.append((df._jdf.queryExecution().optimizedPlan().toString().count("Join "), name))
        return write(df, name)

    monkeypatch.setattr(names, "written", written)
    names.entities(_odd_names(spark))
    assert max(joins)[0] <= 6, sorted(joins)[-5:]


def test_tables_of_names_too_large_to_be_sent(spark, monkeypatch):
    want = rows(names.entities(_odd_names(spark)))
    assert len({r[2] for r in want}) < len(want)
    monkeypatch.setattr(names, "FEW", 0)
    assert rows(names.entities(_odd_names(spark))) == want


# 4 items -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(("heavy", "wide", "memory"), [(0, 2000, 10), (2, 2000, 4_000_000), (50, 2000, 100), (2, 7, 4_000_000)])
def test_pairs_against_brute_force(spark, monkeypatch, heavy, wide, memory):
    monkeypatch.setattr(co_items, "WIDE", wide)
    monkeypatch.setattr(co_items, "PAIR_MEMORY", memory)
    rng = np.random.default_rng(3)
    data = [(int(w), f, None if x == 0 else f"i{x}", "y") for w in range(120) for f in ("a", "b") for x in np.minimum(rng.geometric(0.3, 5), 12) - 1]
    data += data[:50] + [(500, f"f{k}", f"i{k}", "y") for k in range(200)]
    df = spark.createDataFrame(data, "work_id long, field_name string, item string, number string")
    seen = collections.defaultdict(set)
    for w, f, x, _ in data:
        if x is not None:
            seen[f, x].add(w)
    want = set()
    for (f, x), (g, y) in itertools.product(seen, seen):
        if f == g and x < y and len(seen[f, x] & seen[f, y]) >= 3:
            want.add((f, x, y, len(seen[f, x] & seen[f, y])))
    single = {(f, x): len(w) for (f, x), w in seen.items() if len(w) >= 3}
    pairs, items = co_items.pair_counts(df, least=3, heavy=heavy, block_rows=60)
    name = {r["number"]: (r["field_name"], r["item"]) for r in items.collect()}
    got = {(name[r["_a"]][0], *sorted((name[r["_a"]][1], name[r["_b"]][1])), r["n"]) for r in pairs.where("_a <> _b").collect()}
    assert got == want
    assert {name[r["_a"]]: r["n"] for r in pairs.where("_a = _b").collect()} == single
    assert co_items.associated(df.limit(0)).count() == 0


# 5 twins -----------------------------------------------------------------------------------------


TWINS = ["title", "doi", "year"]


def test_twins(spark):
    data = [(1, "A b-C!", "10.1/X", "2001"), (2, "abc", "https://doi.org/10.1/x", " 2001. "), (3, "2001", "ABC", "doi:10.1/x"), (4, "abc", "10.1/x", None), (5, "n/a", "", None), (6, None, "-", "UNKNOWN"), (7, "abc", "10.1/x", "2002"), (None, "abc", "10.1/x", "2001"), (2, "abc", "10.1/x", "2001")]
    df = spark.createDataFrame([(*r, "z") for r in data], "record_id long, title string, doi string, year string, first_id string")
    assert rows(format_twins.copies(df, "record_id", TWINS, (TWINS,))) == [(1, 2), (1, 3), (5, 6)]
    # a value counts in the field it stands in, or in fields of the same normalised name only
    assert rows(format_twins.copies(df, "record_id", TWINS)) == [(1, 2), (5, 6)]
    assert rows(format_twins.copies(df, "record_id", TWINS, (("title", "year"),))) == [(1, 2), (5, 6)]
    assert dict(rows(format_twins.collapsed(df.where("record_id <> 2"), "record_id", TWINS, (TWINS,)))) == {1: 2, 4: 1, 5: 2, 7: 1}
    assert format_twins.copies(df.limit(0), "record_id", TWINS, (TWINS,)).count() == 0
    assert format_twins.normal_names(["DO-I", "Title", "year"], (("title", "year"),)) == ["doi", "title", "title"]


def test_collisions_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(format_twins, "_part", lambda name, c, salt: F.length(c).cast("long"))
    df = spark.createDataFrame([(1, "ab", "x"), (2, "cd", "x"), (3, "AB", "x"), (4, "c d", "x"), (5, "xy", "x"), (6, "x", "ab"), (7, "x", "xy")], "record_id long, title string, doi string")
    assert rows(format_twins.copies(df, "record_id", ["title", "doi"])) == [(1, 3), (2, 4)]
    assert rows(format_twins.copies(df, "record_id", ["title", "doi"], (("title", "doi"),))) == [(1, 3), (1, 6), (2, 4), (5, 7)]


# 7 tokens ----------------------------------------------------------------------------------------


# characters that every release of the Unicode tables knows
texts = st.text(st.characters(exclude_categories=("Cs", "Cn", "Co")), max_size=60) | st.text(alphabet="aeinrst 1-'", max_size=60) | st.text(alphabet="aEÉe\u0301ΣσİßǅA'SlL\u00a0\x1c\u0085 \n7²٣", max_size=30)


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(texts)
def test_ids_equal_the_public_library(text):
    tokenizer, automaton = _both(queries.VOCABULARY)
    ids = automaton.encode(text)
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids
    assert emitted(ids, automaton.decoder()) == text


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(texts)
def test_ids_of_words_equal_the_public_library(text):
    tokenizer, automaton = _both(queries.WORD_VOCABULARY)
    assert automaton.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


_CACHE = {}


def _both(path):
    if path not in _CACHE:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _CACHE[path] = (t, MergeAutomaton(read_vocabulary(path)))
    return _CACHE[path]


@needs_vocabulary
def test_words_of_all_documents(spark, small):
    tokenizer, automaton = _both(queries.WORD_VOCABULARY)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet".replace("sf0.001", "sf0.01")).select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["ids"] for r in queries.p7_word_ids(spark, small.replace("sf0.001", "sf0.01")).collect()}
    assert got == {k: tokenizer.encode(t or "", add_special_tokens=False).ids for k, t in texts.items()}
    assert emitted(automaton.encode("Two  Words, said."), automaton.decoder()) == "two words , said . "


@needs_vocabulary
def test_vocabularies_do_not_meet(tmp_path):
    import json

    with open(queries.VOCABULARY, encoding="utf-8") as f:
        whole = json.load(f)
    whole["model"]["merges"] = whole["model"]["merges"][:49_990] + whole["model"]["merges"][:10]
    (tmp_path / "other.json").write_text(json.dumps(whole))
    assert read_vocabulary(str(tmp_path / "other.json")).key != read_vocabulary(queries.VOCABULARY).key
    whole["normalizer"] = {"type": "BertNormalizer"}
    (tmp_path / "odd.json").write_text(json.dumps(whole))
    with pytest.raises(ValueError, match="BertNormalizer"):
        merge_automaton.read_vocabulary(str(tmp_path / "odd.json"))


@needs_vocabulary
def test_token_columns(spark):
    long = "word " * 20_000 + "a" * 3000
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "<|endoftext|> naïve\r\n", 0), (4, long, 0), (3, "again", 0)], "doc_id long, text string, ids int")
    got = tokens.encode_corpus(df, queries.VOCABULARY)
    t = _both(queries.VOCABULARY)[0]
    for r in got.collect():
        assert r["ids"] == t.encode(r["text"] or "", add_special_tokens=False).ids
    back = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(got.select("doc_id", "ids").where("doc_id = 4"), queries.VOCABULARY).collect()}
    assert back[4] == long
    assert tokens.encode_corpus(df.limit(0), queries.VOCABULARY).count() == 0


def test_repeated_letters_and_gadgets():
    merges = [(97, 97), (256, 97), (97, 98), (256, 258)]  # aa, aaa, ab, aaab
    m = MergeAutomaton(Vocabulary(merges, list(range(260)), r"\S+|\s+"))

    def by_merging(word):
        parts = list(word)
        for k, (u, v) in enumerate(merges):
            i, out = 0, []
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == (u, v):
                    out.append(256 + k)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    for n in range(1, 9):
        for w in itertools.product(b"ab", repeat=n):
            assert m.labels(m.symbols(bytes(w).decode())) == by_merging(w)


# 8 packing ---------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=300))
def test_plan_holds_everything(sizes):
    counts = collections.Counter(sizes)
    plan = packing.plan_containers(counts, 64, grid=16)
    placed, fill = collections.Counter(), collections.Counter()
    for length, _, n, each, base in plan.segments:
        placed[length] += n
        for r in range(n):
            fill[base + r // each] += length
    assert placed == counts and max(fill.values()) <= 64 and len(fill) == plan.containers
    assert plan.containers <= 1 + 1.25 * sum(sizes) / 64 + sum(s > 32 for s in sizes)


def test_pack(spark):
    sizes = [(k, int(n)) for k, n in enumerate([0, 5, 5, 5, 7, 30, 20, 20, 10, 3, 3, 1] * 20)] + [(999, None)]
    df = spark.createDataFrame(sizes, "doc_id long, n int")
    got = packing.pack(df, "doc_id", "n", 20).toPandas()
    held = got.dropna()
    assert held.groupby("container_id").n_tokens.sum().max() <= 20
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == {k: n or 0 for k, n in sizes}
    assert set(held[held.piece_no > 0].doc_id) == {k for k, n in sizes if n == 30}
    assert held.container_id.nunique() == int(held.container_id.max()) + 1 <= 1.02 * held.n_tokens.sum() / 20 + 1
    assert packing.pack(df.limit(0), "doc_id", "n", 20).count() == 0
    fill = packing.container_fill(packing.pack(df, "doc_id", "n", 20), 20).first()
    assert fill["tokens"] == held.n_tokens.sum() and fill["unused_share"] < 0.02


# 9 languages -------------------------------------------------------------------------------------


def _accuracy_data(small):
    import pandas as pd

    docs = pd.read_parquet(f"{small}/documents.parquet".replace("sf0.001", "sf0.01"))
    labels = pd.read_parquet(f"{small}/language_labels.parquet")
    known = dict(zip(labels.label, labels.lang, strict=True))
    docs["own"] = docs.lang.map(known)
    return docs[docs.own.notna() & docs.text.notna() & (docs.n_chars > 100)]


def test_held_out_accuracy(small):
    docs = _accuracy_data(small)
    train, test = docs[docs.doc_id % 2 == 0], docs[docs.doc_id % 2 == 1]
    models = languages.trained(list(zip(train.own, train.text, strict=True)))
    found = [languages.stretches(models, t) for t in test.text]
    single = [(f[0][1], own) for f, own in zip(found, test.own, strict=True) if len(f) == 1]
    # about one label in twenty is wrong by design
    assert np.mean([a == b for a, b in single]) > 0.9
    assert all(0 <= c <= 1 for f in found for _, _, c in f)


def test_mixed_and_odd_texts(spark, small):
    docs = _accuracy_data(small)
    models = languages.trained(list(zip(docs.own, docs.text, strict=True)))
    en = "In contrast to earlier work, we treat citation networks as a consequence of research funding."
    fr = "Cet article étudie les réseaux de citations avec une carte de cocitation."
    es = "Estas conclusiones son útiles para quienes estudian la investigación interdisciplinaria."
    lang = lambda t: [s[1] for s in languages.stretches(models, t)]
    assert lang(f"{en} {en} {fr} {es}") == ["en", "fr", "es"]
    assert lang(f"Summary\n{fr}\nAbstract: {en}") == ["fr", "en"]
    assert lang(f'{en} One work is entitled "Comment mesurer les réseaux? Le cas de la France". {en}') == ["en"]
    assert lang(en.upper()) == ["en"]
    assert lang("1175; 1083 / 2318") == [] == lang("") == lang(None) == lang(" \n ")


def test_every_sentence_counts(small):
    docs = _accuracy_data(small)
    models = languages.trained(list(zip(docs.own, docs.text, strict=True)))
    lang = lambda t: [s[1] for s in languages.stretches(models, t)]
    assert [len(s) for s in languages.sentences("Das ist gut. It is good. Wir gehen heim. Merci beaucoup.")] == [3, 3, 3, 2]
    assert lang("Das ist gut. It is good. Wir gehen heim. Merci beaucoup.")[:3] == ["de", "en", "de"]
    es = "Los datos muestran que los efectos son fuertes para los autores."
    found = lang(f"{es} Thank you very much. {es}")
    assert len(found) == 3 and found[0] == found[2] == "es"
    # a quotation of sentences is sentences, a title in quotes is part of its sentence
    assert lang('"It is good. We go home." Wir gehen heim und lesen die Daten der Autoren.') == ["en", "de"]
    assert lang("« Les effets sont forts pour les auteurs. » The authors used a sample of theses.") == ["fr", "en"]
    assert languages.sentences('One work is entitled "Che cosa ci dicono i dati? Il caso". Next it is.')[0] == ["One", "work", "is", "entitled"]
    assert languages.sentences("Abstract. Two\nlines here. Ja. Gut so. Ende") == [["Abstract", "Two", "lines", "here"], ["Ja", "Gut", "so"], ["Ende"]]
    assert [len(s) for s in languages.sentences("他们去了。我们也去！这是好的？")] == [4, 4, 4]
    long = '"' + "word and word " * 5000 + '" End of it.'
    assert languages.sentences(long) and languages.sentences("(" * 3000 + "a b.")
    # the time of a long text grows with its length
    for piece in ("We saw it (see 1). ", '"Who is it? It is I. Yes." ', "« a b » c (d. E f. G) ", "<b>x y</b> \" "):
        began = time.time()
        languages.sentences(piece * 30_000)
        assert time.time() - began < 20


def test_models_counted_by_executors(spark, small):
    docs = _accuracy_data(small).head(300)
    texts = list(zip(docs.own, docs.text, strict=True))
    here, there = languages.trained(texts), languages.trained_on(spark.createDataFrame(texts, "language string, text string"))
    assert here.languages == there.languages and here.probabilities.keys() == there.probabilities.keys()
    assert all(np.allclose(p, there.probabilities[g]) for g, p in here.probabilities.items())
    assert languages.trained_on(spark.createDataFrame([], "language string, text string")) is None


def test_corrected(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/language_labels.parquet")
    found = languages.corrected(docs.withColumnRenamed("n_chars", "seg_no"), labels, 200)
    assert found.columns == ["doc_id", "seg_no", "lang", "confidence"]
    assert languages.corrected(docs.limit(0), labels).count() == 0
    assert languages.segmented(docs, labels.limit(0)).count() == 0


# queries -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, small, name):
    same(queries.queries()[name](spark, small), connect(small), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, small, name):
    assert queries.queries()[name](spark, small).count() > 0
