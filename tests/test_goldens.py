import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.operators import citation, composite, cooccur, dynamics, entity, graph, ingest, select, text
from quillmill.plans.ranking import ranked
from tests.conftest import rows


def papers(spark, citations, year=2015):
    return spark.createDataFrame([(k, year, c) for k, c in enumerate(citations)], "doc_id long, year int, citation int")


def test_indices(spark):
    p = papers(spark, [10, 8, 5, 4, 3])
    m = p.select("doc_id", F.lit("a").alias("item"))
    r = entity.impact_indices(m, p, 2024).first()
    assert (r["h"], r["g"], round(r["e"], 6), r["m"]) == (4, 5, round(math.sqrt(11), 6), 0.4)
    assert round(r["j"], 6) == 4.203601


@pytest.mark.parametrize("seed", range(4))
def test_indices_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    cits = rng.integers(0, 40, 30).tolist()
    p = papers(spark, cits)
    m = spark.createDataFrame([(k, f"a{k % 3}") for k in range(30)] + [(4, "a1"), (4, None)], "doc_id long, item string")
    for r in entity.impact_indices(m, p, 2024).collect():
        own = sorted((cits[k] for k in range(30) if f"a{k % 3}" == r["item"]), reverse=True)
        assert r["h"] == max([i + 1 for i, c in enumerate(own) if c >= i + 1], default=0)
        assert r["g"] == max([i + 1 for i in range(len(own)) if sum(own[: i + 1]) >= (i + 1) ** 2], default=0)
        assert r["h"] <= r["g"] <= len(own) and r["j"] >= r["h"]


def test_bradford_and_ranks(spark):
    p = spark.createDataFrame([(s,) for s, n in zip("abcde", [5, 3, 2, 1, 1], strict=True) for _ in range(n)], "journal string")
    zones = {r["item"]: r["zone"] for r in entity.bradford(p).collect()}
    assert zones == {"a": 2, "b": 2, "c": 3, "d": 3, "e": 3}
    df = spark.range(200).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("x"), "id")
    order = [F.col("x"), F.col("id")]
    assert rows(ranked(df, order, "x", one_task=10).select("id", "rank", "running")) == rows(ranked(df, order, "x").select("id", "rank", "running"))


def test_specialization(spark):
    cells = {("a", "x"): 2, ("a", "y"): 1, ("b", "x"): 1, ("b", "y"): 4}
    docs = [(e, f) for (e, f), n in cells.items() for _ in range(n)]
    e = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(docs)], "doc_id long, item string")
    f = spark.createDataFrame([(k, x) for k, (_, x) in enumerate(docs)], "doc_id long, item string")
    got = {(r["entity"], r["field"]): (r["ai"], r["si"]) for r in composite.specialization(e, f, 15).collect()}
    assert got == {("a", "x"): (1.7778, 0.28), ("a", "y"): (0.5333, -0.3043), ("b", "x"): (0.5333, -0.3043), ("b", "y"): (1.28, 0.1228)}


def test_sleeping_beauty(spark):
    p = spark.createDataFrame([(k, 2000 + k, 0) for k in range(5)], "doc_id long, year int, citation int")
    refs = spark.createDataFrame([(3, "r")] + [(4, "r")] * 10, "doc_id long, ref string")
    r = citation.sleeping_beauties(refs, p, 10).first()
    assert (r["b"], round(r["sbi"], 4), r["awakening"], r["c0"], r["cm"], r["tm"]) == (14.0, 1.2999, 3, 0, 10, 4)


def test_disruption(spark):
    years = {"R": 2000, "F": 2005, "A": 2010, "B": 2011, "C": 2012, "D": 2013}
    links = [("F", "R"), ("A", "F"), ("B", "F"), ("B", "R"), ("C", "R"), ("D", "F")]
    ids = {x: k for k, x in enumerate(years)}
    cites = spark.createDataFrame([(ids[a], ids[b], years[a], years[b]) for a, b in links], "src long, dst long, src_year int, dst_year int")
    r = {x["doc_id"]: tuple(x) for x in citation.disruption(cites).collect()}[ids["F"]]
    assert r[1:] == (2, 1, 1, 0.25)


def test_bursts():
    found = dynamics.two_state_bursts(np.array([0, 1, 0, 5, 6, 0.0]), np.array([10.0] * 6), 2.0, 1.0)
    assert [(a, b, round(x, 4)) for a, b, x in found] == [(3, 4, 5.0355)]


def test_path_weights(spark):
    flow = [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E")]
    ids = {x: k for k, x in enumerate("ABCDE")}
    names = {k: x for x, k in ids.items()}
    cites = spark.createDataFrame([(ids[v], ids[u]) for u, v in flow], "src long, dst long")
    got = {k: {names[r["u"]] + names[r["v"]]: r["weight"] for r in graph.path_weights(cites, k).collect()} for k in ("spc", "splc", "spnp")}
    assert got["spc"] == {"AB": 1, "AC": 1, "BD": 1, "CD": 1, "DE": 2}
    assert got["splc"] == {"AB": 1, "AC": 1, "BD": 2, "CD": 2, "DE": 5}
    assert got["spnp"] == {"AB": 3, "AC": 3, "BD": 4, "CD": 4, "DE": 4}
    assert [names[r["v"]] for r in graph.main_path(graph.path_weights(cites, "spc")).orderBy("step").collect()] == ["B", "D", "E"]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x", "Part 1"), (2, "y", "Part 2"), (3, "UNKNOWN", "Other"), (4, "x", "Else")], "id long, doi string, title string")
    assert [r["id"] for r in select.first_of_duplicates(df, "id").orderBy("id").collect()] == [1, 3]


def test_small_rules(spark):
    notes = spark.createDataFrame([("Cited by: 52",), ("7; extra",), ("n/a",), ("12 times",), (None,)], "n string")
    assert [r[0] for r in notes.select(ingest.citations(F.col("n"))).collect()] == [52, 7, 0, 12, 0]
    one = spark.createDataFrame([("Café d'Été 12", "Smith 1998, p. 20010, 2005", "A, 2001; note;  B  c ;2004; (1999)")], "t string, r string, s string")
    assert one.select(text.clean_text(F.col("t")), citation.reference_year(F.col("r"), 2004), ingest.split_values(F.col("s"), ";", references=True)).first()[:] == ("caf d't", 1998, ["A, 2001", "B c"])
    types = spark.createDataFrame([("Congress",), ("Letter",), ("congress",), (None,)], "t string")
    assert [r[0] for r in types.select(ingest.document_type(F.col("t"))).collect()] == ["Conference Paper", "Article", "congress", None]
    assert "les" in text.stop_words("French") and text.stop_words("english") == text.STOP_WORDS
    lists = spark.createDataFrame([(1, k, v) for k, v in enumerate(["UNKNOWN", "a", "UNKNOWN", "b", "UNKNOWN"])], "doc_id long, pos int, c string")
    assert [r["c"] for r in ingest.filled_forward(lists, "c").orderBy("pos").collect()] == ["UNKNOWN", "a", "a", "b", "b"]


def test_cocited(spark):
    refs = spark.createDataFrame([(1, x) for x in "abc"] + [(2, x) for x in "ab"] + [(3, x) for x in "bc"], "doc_id long, item string")
    assert rows(cooccur.edges(refs)) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 2)]


def test_centralities_of_a_path(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("x", "y", 1)], "a string, b string, w long")
    assert {r["item"]: r["betweenness"] for r in graph.betweenness(e).collect()} == {"a": 0.0, "b": round(2 / 12, 6), "c": 0.0, "x": 0.0, "y": 0.0}
    assert {r["item"]: r["component"] for r in graph.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert {r["item"]: r["harmonic"] for r in graph.closeness(e).collect()}["b"] == 2.0
    chain = spark.createDataFrame([(k, k + 1, 1) for k in range(60)], "a long, b long, w long")
    assert {r["component"] for r in graph.components(chain).collect()} == {0}


def test_salsa_sums_to_one(spark):
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 3)], "src long, dst long")
    r = graph.salsa(links, 20).agg(F.sum("hub"), F.sum("authority")).first()
    assert abs(r[0] - 1) < 1e-4 and abs(r[1] - 1) < 1e-4
    assert abs(graph.pagerank(links).agg(F.sum("rank")).first()[0] - 1) < 1e-9


def test_streams(spark, tmp_path):
    from quillmill.streaming import terms

    spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 01:00:00", "a"), (3, "2024-01-09 00:00:00", "b")], "id long, ts string, k string").select("id", F.to_timestamp("ts").alias("ts"), "k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp, k string").parquet(str(tmp_path / "in"))
    q = terms.windowed_counts(stream, "k").writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert [(r["item"], r["n"]) for r in spark.table("counted").collect()] == [("a", 2)]


def test_fuzzy_against_all_pairs(spark):
    from quillmill.operators import fuzzy

    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("abcde"), int(rng.integers(3, 8)))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words] + [(None,), ("",)], "t string")
    want = {(a, b) for k, a in enumerate(words) for b in words[k + 1 :] if round(fuzzy.block_ratio(a, b), 6) >= 0.8}
    assert {(r["a"], r["b"]) for r in fuzzy.similar_pairs(df, "t", 0.8).collect()} == want
    m = spark.createDataFrame([("Journal of Maps",)] * 3 + [("journal of mapps",), ("Letters",)], "item string")
    assert rows(fuzzy.normalized_entities(m)) == [("journal of mapps", "Journal of Maps", 1)]


def test_first_split_and_internal_references(spark):
    from quillmill.operators import temporal

    two = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "x"), ("x", "y"), ("y", "z"), ("x", "z")]
    parts = {r["item"]: r["part"] for r in graph.first_split(spark.createDataFrame([(*e, 1) for e in two], "a string, b string, w long")).collect()}
    assert {k for k, v in parts.items() if v == 0} == {"a", "b", "c"}
    papers = spark.createDataFrame([(1, "10.1/A", "Maps of science", "adams", 2001), (2, None, "Networks of citations in maps", "baker", 2002), (3, None, "Unrelated", "cole", 2003)], "doc_id long, doi string, title string, author string, year int")
    refs = spark.createDataFrame([(3, "r1", "10.1/a", None, None, None), (3, "r2", None, "Networks of citation in maps", None, None), (2, "r3", None, None, "Cole", 2003), (1, "r4", None, None, "none", 1)], "doc_id long, ref string, doi string, title string, author string, year int")
    assert rows(temporal.internal_references(papers, refs)) == [(2, "r3", 3), (3, "r1", 1), (3, "r2", 2)]


def test_brokerage_takes_every_pair_and_every_author(spark, small):
    from quillmill.queries import queries
    from quillmill.sources.views import Views

    v = Views(spark, small)
    mentions = v.authors.select("doc_id", F.col("author").alias("item"))
    edges, got = cooccur.edges(mentions), {r["item"]: r["score"] for r in queries()["brokerage"](spark, small).collect()}
    assert set(got) == {r["item"] for r in mentions.select("item").distinct().collect()}
    docs = entity.presence(mentions).groupBy("item").agg(F.count("*").alias("n_docs"))
    parts = docs.join(graph.betweenness(edges, digits=None), "item", "left").join(graph.degree(edges).select("item", "strength"), "item", "left").join(graph.constraint(edges), "item", "left")
    want = {r["item"]: r["score"] for r in composite.brokerage(parts.fillna(0, ["betweenness", "strength"])).collect()}
    assert all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_dense_constraint_is_the_joined_one(spark):
    e = spark.createDataFrame([("a", "b", 2), ("b", "c", 1), ("a", "c", 3), ("c", "d", 1)], "a string, b string, w long")
    got = {r["item"]: round(r["constraint"], 6) for r in graph.constraint_of_dense(e).collect()}
    assert got == {r["item"]: r["constraint"] for r in graph.constraint(e).collect()}


@pytest.mark.parametrize("searched", [1, 1e9])
def test_graphs_beyond_one_task_by_components(spark, monkeypatch, searched):
    import numpy as np

    rng = np.random.default_rng(6)
    dense = {tuple(sorted(map(int, x))) for x in rng.integers(0, 30, (150, 2)) if x[0] != x[1]}
    chain = {(100 + k, 101 + k) for k in range(210)} | {(100, 105)}
    e = spark.createDataFrame([(f"n{a:03}", f"n{b:03}", 1 + (a * b) % 4) for a, b in dense | chain | {(900, 901)}], "a string, b string, w long")
    near = lambda x, y: x.keys() == y.keys() and all(abs(x[k] - y[k]) < 1e-9 for k in x)
    monkeypatch.setattr(graph, "SEARCHED", searched)
    monkeypatch.setattr(graph, "CELLS", 200)
    for f in (lambda limit: graph.betweenness(e, limit, digits=None), lambda limit: graph.constraint_of_dense(e, limit)):
        assert near(dict(rows(f(10))), dict(rows(f(10_000))))


@pytest.mark.parametrize(("piece", "weight"), [(40, 1), (10_000, 4), (40, 2.5), (40, 70_000)])
def test_large_components_are_read_from_files(spark, monkeypatch, tmp_path, piece, weight):
    rng = np.random.default_rng(8)
    near = {tuple(sorted(map(int, x))) for x in rng.integers(0, 60, (150, 2)) if x[0] != x[1]} | {(k, k + 1) for k in range(70)} | {(k, k + 1) for k in range(200, 240)} | {(300, 301)}
    e = spark.createDataFrame([(a, b, 1.0 + (weight - 1) * (a * b % 2)) for a, b in near], "a long, b long, w double")
    want = dict(rows(graph.betweenness(e, digits=None))), dict(rows(graph.constraint_of_dense(e)))
    for name, value in (("HELD", 20), ("PIECE", piece), ("CELLS", 200)):
        monkeypatch.setattr(graph, name, value, raising=False)
    got = dict(rows(graph.betweenness(e, 10, digits=None))), dict(rows(graph.constraint_of_dense(e, 10)))
    assert all(x.keys() == y.keys() and all(abs(x[k] - y[k]) < 1e-9 for k in x) for x, y in zip(got, want, strict=True))


def test_searches_hold_few_arcs(monkeypatch):
    import tracemalloc

    n, rng = 3_000, np.random.default_rng(9)
    a, b = np.nonzero(np.triu(rng.random((n, n)) < 0.04, 1))
    src, ends = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort([ends, src])
    starts, ends = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]), ends[order].astype("u2")
    monkeypatch.setattr(graph, "PIECE", 20_000, raising=False)
    monkeypatch.setattr(graph, "HELD", 20_000, raising=False)
    for search, w in ((graph._dependencies_of_all, None), (graph._constraints_of, np.ones(len(ends), "u1"))):
        tracemalloc.start()
        search(starts, ends, w, np.arange(3))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 2e6 < 8 * len(ends)


def test_collaboration_network_beyond_one_task(spark, monkeypatch):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "x"), (3, "y"), (4, "z")], "doc_id long, item string")
    papers = spark.createDataFrame([(k, k) for k in range(1, 5)], "doc_id long, citation int")
    monkeypatch.setattr(graph.betweenness, "__defaults__", (1, 6))
    got = {r["item"]: (r["degree"], r["betweenness"]) for r in composite.collaboration_network(m, papers).collect()}
    assert got == {"a": (1, 0.0), "b": (2, round(2 / 12, 6)), "c": (1, 0.0), "x": (1, 0.0), "y": (1, 0.0), "z": (0, 0.0)}


def test_numbered_edges_are_short(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (2, None), (4, "z")], "doc_id long, item string")
    pairs, names = cooccur.numbered_edges(m)
    of = {r["number"]: r["item"] for r in names.collect()}
    assert sorted(of.values()) == ["a", "b", "c", "z"] and pairs.dtypes[:2] == [("a", "bigint"), ("b", "bigint")]
    assert sorted((of[r["a"]], of[r["b"]], r["w"]) for r in pairs.collect()) == [("a", "b", 1), ("b", "c", 1)]


def test_directed_betweenness(spark):
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (1, 5)], "src long, dst long")
    nodes = spark.createDataFrame([(k,) for k in range(1, 7)], "item long")
    got = {r["item"]: r["betweenness"] * 20 for r in graph.directed_betweenness(links, nodes).collect()}
    assert got == pytest.approx({1: 0, 2: 0.5, 3: 0.5, 4: 2, 5: 0, 6: 0})


def test_bridge_scores_of_every_paper(spark, small):
    from quillmill.queries import queries
    from quillmill.sources.views import Views

    got = queries()["bridge_scores"](spark, small).select("item").collect()
    assert sorted(r["item"] for r in got) == sorted(r["doc_id"] for r in Views(spark, small).papers.collect())


def test_union_corpora_keeps_columns_and_prefers_the_old(spark, small):
    from quillmill.queries import queries

    papers = spark.read.parquet(f"{small}/papers.parquet")
    got, raw = queries()["union_corpora"](spark, small).collect(), {r["record_id"]: r for r in papers.collect()}
    assert set(got[0].asDict()) == set(papers.columns)
    assert all(r["journal"] == (raw[r["record_id"]]["journal"] or "UNKNOWN") for r in got if raw[r["record_id"]]["journal"] != "")
    old = lambda r: (r["source"] or "").strip(" ").lower() in ("scopus", "scopus export")
    titles = lambda rs: {r["title"] for r in rs if old(r) and r["title"]}
    shared = titles(raw.values()) & {r["title"] for r in raw.values() if not old(r)}
    assert shared and not any(r["title"] in shared and not old(r) for r in got)


def test_salsa_iterates_to_the_tolerance(spark):
    links = spark.createDataFrame([(k, 100 + k) for k in range(3)] + [(k + 1, 100 + k) for k in range(3)], "src long, dst long")
    got = graph.salsa(links).collect()
    assert sum(abs(r["authority"] - (1 / 3 if r["item"] >= 100 else 0)) for r in got) < 1e-4
    assert sum(abs(r["hub"] - {0: 1, 3: 1}.get(r["item"], 2) / 6 * (r["item"] < 100)) for r in got) < 1e-4
    tops = graph.decade_tops(graph.salsa(links, 2), spark.createDataFrame([(k, 1999) for k in range(4)] + [(100, 2003), (200, -1)], "item long, year int"), 5).collect()
    assert {(r["decade"], r["kind"]) for r in tops} == {(1990, "hub"), (1990, "authority"), (2000, "hub"), (2000, "authority")} and len(tops) == 10


def test_long_chains(spark):
    n = 33
    chain = spark.createDataFrame([(k + 1, k) for k in range(n)], "src long, dst long")
    assert {r["item"]: r["depth"] for r in graph.depths(chain).collect()} == {k: k for k in range(n + 1)}
    spc = graph.path_weights(chain, "spc")
    assert {r["weight"] for r in spc.collect()} == {1.0}
    assert sorted(tuple(r) for r in graph.main_path(spc).collect()) == [(k, k, k + 1) for k in range(n)]
    assert {(r["u"], r["weight"]) for r in graph.path_weights(chain, "splc").collect()} == {(k, k + 1.0) for k in range(n)}
    assert {(r["u"], r["weight"]) for r in graph.path_weights(chain, "spnp").collect()} == {(k, (k + 1.0) * (n - k)) for k in range(n)}
    with pytest.raises(ValueError, match="more than 20"):
        graph.depths(chain, most=20)


def test_cycles_are_errors(spark):
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    for f in (graph.depths, graph.path_weights):
        with pytest.raises(ValueError, match="cycle"):
            f(ring)


def test_load_and_communities(spark):
    # two ways from a to d, one of them by two nodes: load is split evenly, betweenness by paths
    e = spark.createDataFrame([("a", "b", 1), ("a", "c", 1), ("b", "d", 1), ("c", "d", 1), ("d", "e", 1)], "a string, b string, w long")
    got = {r["item"]: round(r["load"] * 12, 6) for r in graph.load(e, digits=None).collect()}
    assert got == {"a": 1.0, "b": 2.0, "c": 2.0, "d": 7.0, "e": 0.0}
    two = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "x"), ("x", "y"), ("x", "z"), ("y", "z")]
    parts = {r["item"]: r["community"] for r in graph.greedy_modularity(spark.createDataFrame([(*t, 1) for t in two], "a string, b string, w long")).collect()}
    assert parts == {"a": 1, "b": 1, "c": 1, "x": 2, "y": 2, "z": 2}
    assert graph.greedy_modularity(e.limit(0)).count() == 0


def test_no_shared_folder_is_an_error(spark, monkeypatch):
    from quillmill.plans import lineage

    class Away:
        class sparkContext:
            master = "spark://far:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_dir(Away)
