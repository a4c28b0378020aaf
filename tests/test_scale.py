import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.operators import citation, composite, cooccur, dynamics, nested, text
from quillmill.plans import split_join
from tests.conftest import rows


def test_split_join_is_the_join(spark):
    rng = np.random.default_rng(1)
    left = spark.createDataFrame([(int(k), int(x)) for k, x in enumerate(rng.integers(0, 4, 60))], "a int, k int")
    right = spark.createDataFrame([(int(k), int(x)) for k, x in enumerate(np.minimum(rng.integers(0, 9, 80), 3))], "b int, k int")
    want = rows(left.join(right, ["k"]).select("k", "a", "b"))
    assert rows(split_join(left, right, ["k"], block=7).select("k", "a", "b")) == want
    assert rows(split_join(left, right, ["k"], block=1000).select("k", "a", "b")) == want
    assert split_join(left.limit(0), right, ["k"]).count() == 0


def _corpus(rng, hot):
    """Papers of which a third cite the same reference, some with equal lists, some with a reference twice."""
    docs = {}
    for d in range(90):
        refs = [f"r{x}" for x in rng.integers(0, 25, int(rng.integers(1, 6)))]
        docs[d] = [*refs, *([hot] if d % 3 == 0 else [])]
    return docs | {100: docs[0], 101: docs[0][::-1], 102: ["hot"], 103: ["hot"]}


@pytest.mark.parametrize("block", [3, 2000])
def test_coupling_with_a_hot_reference(spark, monkeypatch, block):
    monkeypatch.setattr(cooccur, "PAIR_BLOCK", block)
    monkeypatch.setattr(split_join, "__defaults__", (block,))
    docs = _corpus(np.random.default_rng(2), "hot")
    refs = spark.createDataFrame([(d, r, "x") for d, rs in docs.items() for r in rs] + [(5, None, "x")], "doc_id long, ref string, class_id string")
    counts = {d: {r: rs.count(r) for r in rs} for d, rs in docs.items()}
    first = {d: min(e for e in counts if counts[e] == counts[d]) for d in counts}
    assert dict(rows(cooccur.reference_classes(refs))) == first
    want = set()
    for a, b in itertools.combinations(sorted(set(first.values())), 2):
        x, y = counts[a], counts[b]
        dot = sum(n * y.get(r, 0) for r, n in x.items())
        cos = dot / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))
        if cos >= 0.3:
            want.add((a, b, len(set(x) & set(y)), round(cos, 6)))
    assert {tuple(r) for r in cooccur.coupling(refs, 0.3).collect()} == want
    sets = {d: set(rs) for d, rs in docs.items()}
    reps = sorted({min(e for e in sets if sets[e] == s) for s in sets.values()})
    assert {tuple(r) for r in cooccur.shared_references(refs, 2).collect()} == {(a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(reps, 2) if len(sets[a] & sets[b]) >= 2}


def test_edges_of_long_papers(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "SLICE", 3)
    docs = {1: "abcdefgh", 2: "abcd", 3: "ah", 4: "z"}
    m = spark.createDataFrame([(d, x) for d, xs in docs.items() for x in xs] + [(1, "a"), (1, None)], "doc_id long, item string")
    for least in (1, 2):
        want = {(a, b, n) for a, b in itertools.combinations("abcdefghz", 2) if (n := sum(a in xs and b in xs for xs in docs.values())) >= least}
        assert {tuple(r) for r in cooccur.edges(m, least=least).collect()} == want


def test_disruption_with_hot_references(spark, monkeypatch):
    rng = np.random.default_rng(3)
    links = {(int(a), int(b)) for a, b in zip(rng.integers(10, 60, 150), rng.integers(0, 40, 150), strict=True) if a > b} | {(k, 0) for k in range(20, 60)}
    cites = spark.createDataFrame([(a, b, 1900 + a, 1900 + b) for a, b in links], "src long, dst long, src_year int, dst_year int")
    whole = rows(citation.disruption(cites))
    monkeypatch.setattr(split_join, "__defaults__", (5,))
    assert rows(citation.disruption(cites)) == whole


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([(k, rng.normal(size=4).tolist() if k % 17 else [0.0] * 4) for k in range(120)] + [(500, None)], "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 3 = 0")
    one = rows(text.nearest(asked, vectors, 4))
    assert rows(text.nearest(asked, vectors, 4, block=7, vector_block=11)) == one and len(one) == 4 * 37
    assert text.nearest(asked.limit(0), vectors, 4).count() == 0


def test_trigrams_across_and_within(spark):
    a = spark.createDataFrame([(1, "networks of citation"), (9, "maps of science")], "k long, t string")
    b = spark.createDataFrame([(5, "network of citations"), (2, "Maps of Science!")], "k long, t string")
    assert {(r["a"], r["b"]) for r in text.trigram_pairs(a, b, "k", "t", 0.6).collect()} == {(1, 5), (9, 2)}
    assert {(r["a"], r["b"]) for r in text.trigram_pairs(a.union(b), a.union(b), "k", "t", 0.6, across=False).collect()} == {(1, 5), (2, 9)}


def test_bursts_without_years(spark):
    p = spark.createDataFrame([(k, 2000 + k // 10) for k in range(60)] + [(99, None)], "doc_id long, year int")
    terms = spark.createDataFrame([(k, "t") for k in (11, *range(30, 36), *range(40, 47), 99)], "doc_id long, item string")
    assert [tuple(r)[:3] for r in dynamics.bursts(terms, p).collect()] == [("t", 2003, 2004)]
    with pytest.raises(ValueError, match="greater than 1"):
        dynamics.bursts(terms, p, s=1)


def test_clean_names(spark):
    m = spark.createDataFrame([("São Paulo",), ("Sao Paulo",), ("Sao Paulo",), ("—",), ("???",)], "item string")
    assert rows(composite.exact_clean_names(m)) == [("São Paulo", "Sao Paulo")]


def test_last_delivery_of_a_work(spark):
    one = '{"id": "W1", "cited_by_count": %s, "display_name": "%s", "publication_year": "2001"}'
    df = spark.createDataFrame([(one % (9, "late"), 3), (one % (10, "early"), 2), (one % (99, "null"), None)], "payload string, loaded_at long").withColumn("loaded_at", F.timestamp_seconds("loaded_at"))
    r = nested.works_table(df).first()
    assert (r["work_id"], r["display_name"], r["cited_by_count"], r["publication_year"]) == ("W1", "late", 9, 2001)
    assert nested.works_table(df.drop("loaded_at")).count() == 1


def test_look_ups_without_hot_keys(spark, monkeypatch):
    from quillmill.plans import looked_up, sizing

    rows_ = spark.createDataFrame([(k, "hot" if k % 3 else f"g{k % 10}") for k in range(60)], "x long, g string")
    table = rows_.where("g <> 'g3'").groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("low"))
    want = rows(rows_.join(table.drop("n"), ["g"], "left").select("x", "g", "low"))
    assert rows(looked_up(rows_, table, ["g"], "n").select("x", "g", "low")) == want
    monkeypatch.setattr(sizing, "split_hot", lambda counted, n, total: F.col(n) > 10)
    got = looked_up(rows_, table, ["g"], "n", keep="n", few=1)
    assert rows(got.select("x", "g", "low")) == want and "n" in got.columns


@pytest.mark.parametrize("few", [2000, 0])
def test_titles_in_references(spark, monkeypatch, few):
    monkeypatch.setattr(citation, "FEW_TITLES", few)
    titles = {1: "Maps of Science", 2: "Optics", 3: "open Access", 4: "Unknown", 5: None, 6: " ", 7: "tworks of citation and m", 8: "Nothing like this here"}
    refs = {(1, "A, Networks of Citation and Maps of Science, 1999"), (1, "B, MARINE OPTICS LETTERS"), (2, "C, On open access"), (3, "D, maps of scientists"), (3, None)}
    papers = spark.createDataFrame(list(titles.items()), "doc_id long, title string")
    got = {tuple(r) for r in citation.named_titles(spark.createDataFrame(list(refs), "doc_id long, ref string"), papers).collect()}
    assert got == {(d, r, k) for d, r in refs if r for k, t in titles.items() if t and t.strip() and t != "Unknown" and t.lower() in r.lower()}


@pytest.mark.parametrize("few", [2000, 0])
def test_counts_of_titles_in_references(spark, monkeypatch, few):
    from quillmill.plans import joined_in_parts, sizing

    monkeypatch.setattr(citation, "FEW_TITLES", few)
    monkeypatch.setattr(citation, "joined_in_parts", lambda *a: joined_in_parts(*a, few=1 if few == 0 else sizing.BROADCAST_ROWS))
    titles = [(1, "Maps of Science"), (2, "2017"), (3, "2017"), (4, "Optics"), (4, "maps of science"), (4, "Optics"), (None, "Optics"), (5, "Unknown"), (6, "no such words here")]
    refs = [(1, "A, Maps of Science, 2017"), (1, "A, Maps of Science, 2017"), (2, "marine OPTICS and maps of science"), (3, None), (None, "2017"), (4, "of science, maps"), (7, "2017")]
    papers = spark.createDataFrame(titles, "doc_id long, title string")
    references = spark.createDataFrame(refs, "doc_id long, ref string")
    named = {(d, r, k) for d, r in refs if r for k, t in titles if k and t != "Unknown" and t.lower() in r.lower()}
    got = {tuple(r) for r in citation.named_title_counts(references, papers).collect()}
    assert got == {(d, sum(x[0] == d for x in named)) for d in {x[0] for x in named}}
    years = spark.createDataFrame([(1, 2001), (2, 2001), (7, 2003), (9, 2004), (8, None)], "doc_id long, year int")
    want = {2001: sum(x[0] in (1, 2) for x in named), 2003: sum(x[0] == 7 for x in named), 2004: 0}
    assert dict(rows(citation.past_citations(citation.named_title_counts(references, papers), years))) == want
    assert dict(rows(citation.past_citations(citation.named_titles(references, papers), years))) == want


@pytest.mark.parametrize("few", [2000, 0])
def test_words_and_pieces_of_references_are_not_stored(spark, monkeypatch, few):
    monkeypatch.setattr(citation, "FEW_TITLES", few)
    stored = []
    for name in ("written", "checkpointed"):
        real = getattr(citation, name)
        monkeypatch.setattr(citation, name, lambda df, *a, real=real: stored.append(real(df, *a)) or stored[-1])
    refs = spark.createDataFrame([(k, f"Author{k}, a text with many words about field {k}, 1999") for k in range(300)] + [(300, "maps of science, 2017")], "doc_id long, ref string")
    papers = spark.createDataFrame([(1, "Maps of Science"), *((k, "2017") for k in range(2, 40)), (50, "words never met about field")], "doc_id long, title string")
    assert [tuple(r) for r in citation.named_title_counts(refs, papers).collect()] == [(300, 39)]
    assert sorted(df.count() for df in stored)[-2:] in ([3, 301], [4, 301], [1, 301])  # the references themselves, once


def test_trigram_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    words = ["network", "citation", "marine", "optics", "maps", "of", "science", "sciences"]
    texts = sorted({" ".join(rng.choice(words, int(rng.integers(2, 6)))) for _ in range(60)})
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    grams = [{t[i : i + 3] for i in range(max(1, len(t) - 2))} for t in texts]
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(grams[a] & grams[b]) >= 0.6 * len(grams[a] | grams[b])}
    assert {(r["a"], r["b"]) for r in text.trigram_pairs(df, df, "k", "t", 0.6, across=False).collect()} == want
