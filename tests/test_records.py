import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import clean
from quillmill.operators import nested, packed
from tests.conftest import rows

CASES = [
    ("author", "Doe, J. and ROE,  R.", ["Doe, J.", "ROE, R."]),
    ("author", '"Adams, T.", "Baker, F."', ["Adams, T.", "Baker, F."]),
    ("author", "Adams T, van der Berg UB, Cole E", ["Adams T", "van der Berg UB", "Cole E"]),
    ("author", "N. H. al-Amin, A. R. Baker & K. L. Cole", ["N. H. al-Amin", "A. R. Baker", "K. L. Cole"]),
    ("author", "Adams, Anna AND Baker, Bo", ["Adams, Anna", "Baker, Bo"]),
    ("author", 'Adams, A.; "Group for Maps and Lists"', ["Adams, A.", "Group for Maps and Lists"]),
    ("author", "Adams, Anna", ["Adams, Anna"]),
    ("author_keywords", "food, fermented; water, drinking; ", ["food, fermented", "water, drinking"]),
    ("author_keywords", 'a b, "maps; thematic", "food, fermented"', ["a b", "maps; thematic", "food, fermented"]),
    ("author_keywords", 'x | "the ""open"" index"', ["x", 'the "open" index']),
    ("author_keywords", "'h-index','children's health'", ["h-index", "children's health"]),
    ("author_keywords", "«a b», «and/or graphs»", ["a b", "and/or graphs"]),
    ("author_keywords", "/ a / and/or graphs / b", ["a", "and/or graphs", "b"]),
    ("author_keywords", "· networks, neural · applied", ["networks, neural", "applied"]),
    ("references", "[1] A B, 2001, X [2] C D, 2002, Y", ["A B, 2001, X", "C D, 2002, Y"]),
    ("references", "1. A, (1998)\n2. B, (1999)", ["A, (1998)", "B, (1999)"]),
    ("references", '"A, 1; part two", "B, 2"', ["A, 1; part two", "B, 2"]),
    ("references", "A, 1;\n   B,  2 ; ;", ["A, 1", "B, 2"]),
    ("affiliation", "A, X<br>B, Y // C", ["A, X", "B, Y", "C"]),
    ("affiliation", '(1) "Unit A; Annex, D"\n(2) E, F', ["Unit A; Annex, D", "E, F"]),
    ("affiliation", "n/a", []),
    ("affiliation", " ; | ", []),
    ("references", None, []),
    ("references", '"never closed; one', ["never closed; one"]),
]


def test_packed_cells(spark):
    for f in packed.PACKINGS:
        mine = [(k, c) for k, (g, c, _) in enumerate(CASES) if g == f]
        df = spark.createDataFrame(mine, "k int, c string").select("k", packed.values_of(F.col("c"), packed.PACKINGS[f]).alias("v"))
        got = {r["k"]: r["v"] for r in df.collect()}
        for k, _ in mine:
            assert got[k] == CASES[k][2], CASES[k]


def test_unpacked_columns_and_clashes(spark):
    df = spark.createDataFrame([(1, "A B; C D", None, "", "-", "mine", "too")], "record_id long, author string, author_keywords string, references string, affiliation string, pos string, item string")
    assert rows(packed.unpacked(df, "record_id")) == [(1, "author", 0, "A B"), (1, "author", 1, "C D")]
    assert packed.unpacked(df.limit(0), "record_id").count() == 0


word = st.text(alphabet="abcdefgh", min_size=1, max_size=6)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(word, min_size=1, max_size=5), min_size=1, max_size=20), st.sampled_from([";", "|", "\n", " / ", "；"]))
def test_round_trip(spark, cells, delimiter):
    df = spark.createDataFrame([(k, delimiter.join(c)) for k, c in enumerate(cells) if delimiter.join(c) not in clean.MISSING_WORDS], "k int, c string")
    for r in df.select("k", packed.values_of(F.col("c"), packed.PACKINGS["author_keywords"]).alias("v")).collect():
        assert r["v"] == cells[r["k"]]


def test_nested(spark):
    payloads = [
        "﻿ " + json.dumps({"id": "https://openalex.org/W1/", "referenced_works": ["W2", None, "openalex:W3"], "abstract_inverted_index": {"b": [1], "a": [0, "2"]}}),
        json.dumps([{"id": "W1", "referenced_works": ["W2"]}, None, 3, {"id": None, "referenced_works": ["W9"]}]),
        json.dumps({"results": [{"id": "W4", "referenced_works": "https://openalex.org/W5; W6"}, None]}),
        '{"id": "W7", "referenced_works": ["W8"]} tail', '{"id": "W7", "referenced_works": ["W8"', None, "", "null", "{}",
    ]
    df = spark.createDataFrame([(p, "x") for p in payloads], "payload string, item string")
    ref, word = "referenced_works", "abstract_inverted_index"
    want = [("W1", word, 0, "a"), ("W1", word, 1, "b"), ("W1", word, 2, "a"), ("W1", ref, 0, "W2"), ("W1", ref, 2, "W3"), ("W4", ref, 0, "W5"), ("W4", ref, 1, "W6")]
    assert rows(nested.flattened(df)) == sorted(want, key=repr)
    assert nested.flattened(df.limit(0)).count() == 0
    assert {r["work_id"] for r in nested.works_table(df).collect()} == {"W1", "W4"}


def test_clean_columns(spark):
    df = spark.createDataFrame([(" UnKnown ", "https://doi.org/10.1/AB."), (" ", "DOI: {10.22/x y}"), ("x", "10.9096"), (None, None)], "a string, d string")
    assert [tuple(r) for r in df.select(clean.is_missing(F.col("a")), clean.bare_doi(F.col("d"))).collect()] == [(True, "10.1/ab"), (True, None), (False, None), (True, None)]


def test_very_long_cells(spark):
    names = [f"Adams{'abcdefghij'[k % 10]} T{'ABC'[k % 3]}" for k in range(20_000)]
    first = [f"A. B. Baker{'abcdefghij'[k % 10]}" for k in range(20_000)]
    quoted = [f'Part {k}; "" and more' for k in range(20_000)]
    long = "it isn't " * 5000 + "the end"
    cells = [
        ("author", ", ".join(names), names), ("author", ", ".join(first), first), ("author_keywords", "; ".join(f'"{q}"' for q in quoted), [q.replace('""', '"') for q in quoted]),
        ("author_keywords", f"'{long}'; b", [long, "b"]), ("author", "A. " * 20_000 + "Baker, C. Cole", ["A. " * 20_000 + "Baker", "C. Cole"]), ("author_keywords", "'" * 20_000 + "x", None),
        ("references", "\n".join(f'[{k % 1000}] "A {k}, 2001; part"' for k in range(20_000)), [f"A {k}, 2001; part" for k in range(20_000)]),
    ]
    for k, (f, cell, want) in enumerate(cells):
        df = spark.createDataFrame([(cell,)], "c string").select(packed.values_of(F.col("c"), packed.PACKINGS[f]).alias("v"))
        got = df.first()["v"]
        assert want is None or got == want, (k, got[:3])
