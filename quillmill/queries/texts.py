"""Queries on texts, vectors, graphs, records and event time, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import citation, composite, cooccur, crosstab, entity, fuzzy, graph, ingest, select, temporal, text
from quillmill.operators.packed import PACKINGS, unpacked
from quillmill.plans import checkpointed
from quillmill.sources.views import SQL, Views
from quillmill.streaming import terms

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        _Q[name] = lambda spark, folder: f(Views(spark, folder))
        if sql is not None:
            _S[name] = sql.replace("--views", SQL)
        return f

    return add


_STOP = ", ".join("'" + w + "'" for w in text.STOP_WORDS)
_TOKENS = f"WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP})) AS t FROM documents WHERE text IS NOT NULL)"


@query("ngrams_top", f"""{_TOKENS}, g AS (SELECT t[i] || ' ' || t[i + 1] AS ngram FROM (SELECT t, unnest(range(1, len(t))) AS i FROM t))
SELECT ngram, count(*) AS n FROM g GROUP BY ngram ORDER BY n DESC, ngram LIMIT 50""")
def ngrams_top(v: Views) -> DataFrame:
    return text.ngrams(v.table("documents"), "text", 2).orderBy(F.col("n").desc(), "ngram").limit(50)


@query("word_weights", f"""{_TOKENS}, w AS (SELECT unnest(t) AS term FROM t), c AS (SELECT term, count(*) AS n FROM w GROUP BY term ORDER BY n DESC, term LIMIT 40)
SELECT term, n, round(n * 1.0 / max(n) OVER (), 6) AS weight FROM c""")
def word_weights(v: Views) -> DataFrame:
    return text.word_weights(v.table("documents"), "text", 40)


@query("tf_idf", f"""{_TOKENS}, f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
n AS (SELECT count(*) AS n FROM t), w AS (SELECT f.doc_id, f.term, tf * (ln((1 + n) * 1.0 / (1 + df)) + 1) AS w FROM f JOIN d USING (term) CROSS JOIN n)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 5) AS weight FROM w""")
def tf_idf(v: Views) -> DataFrame:
    return text.tf_idf(v.table("documents"), "doc_id", "text").withColumn("weight", F.round("weight", 5))


@query("doc_find_words", "SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^a-z0-9]+'), ['citation', 'networks', 'study'])")
def doc_find_words(v: Views) -> DataFrame:
    return text.with_words(v.table("documents"), "text", ["citation", "networks", "study"]).select("doc_id")


@query("clean_text", f"""WITH a AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), ' +'), lambda w: w NOT IN ({_STOP.replace("''", "'")})), ' ') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '[^a-zA-Z0-9'' ]+', '', 'g'), '[0-9]+', '', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM a""")
def clean_text(v: Views) -> DataFrame:
    docs = v.table("documents").where("text is not null")
    return docs.select("doc_id", text.clean_text(F.col("text"), text.STOP_WORDS).alias("cleaned"))


@query("nearest_vectors", """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query, e.vec_id AS neighbour,
round(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(e.embedding[i] AS DOUBLE))) / sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) / sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS score FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS place FROM s) SELECT query, neighbour, score, place FROM r WHERE place <= 5""")
def nearest_vectors(v: Views) -> DataFrame:
    vectors = v.table("embeddings")
    return text.nearest(vectors.where("vec_id % 50 = 0"), vectors, 5)


_TITLES = """WITH p AS (SELECT record_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t FROM papers WHERE title IS NOT NULL AND lower(trim(regexp_replace(title, '[\\s\\x{00a0}\\x{200b}\\x{feff}]+', ' ', 'g'))) NOT IN ('', 'unknown', 'unkn', 'n/a', 'none', '-')),
m AS (SELECT record_id, min(record_id) OVER (PARTITION BY t) AS class_id, t FROM p), c AS (SELECT DISTINCT class_id AS id, t FROM m),
g AS (SELECT id, list_distinct(list_transform(range(1, greatest(1, length(t) - 2) + 1), lambda i: substr(t, i, 3))) AS g FROM c), u AS (SELECT id, len(g) AS n, unnest(g) AS g FROM g),
x AS (SELECT a.id AS a, b.id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
s AS (SELECT a, b, k * 1.0 / (na + nb - k) AS jaccard FROM x WHERE k * 1.0 / (na + nb - k) >= 0.7)"""


def _title_classes(v: Views) -> DataFrame:
    """(record_id, class_id, t): titles that are the same but for what trigrams do not see."""
    known = v.table("papers").where(~select.clean.is_missing(F.col("title"))).select("record_id", text.trigram_text(F.col("title")).alias("t"))
    return known.join(known.groupBy("t").agg(F.min("record_id").alias("class_id")), "t")


def _title_pairs(classes: DataFrame) -> DataFrame:
    firsts = checkpointed(classes.where("record_id = class_id").select("record_id", "t"))
    return text.trigram_pairs(firsts, firsts, "record_id", "t", 0.7, across=False)


@query("near_title_pairs", f"{_TITLES} SELECT a, b, round(jaccard, 6) AS jaccard FROM s")
def near_title_pairs(v: Views) -> DataFrame:
    """Pairs of the first records of two classes of titles."""
    return _title_pairs(_title_classes(v)).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("near_titles", f"{_TITLES}, l AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM s UNION ALL SELECT b FROM s) GROUP BY id) SELECT m.record_id, m.class_id, coalesce(l.n, 0) AS n_links FROM m LEFT JOIN l ON l.id = m.class_id")
def near_titles(v: Views) -> DataFrame:
    """Every record with a title, the first record with the same one, and to how many other titles it is near."""
    classes = _title_classes(v)
    pairs = _title_pairs(classes)
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("_n"))
    return classes.join(links, "class_id", "left").select("record_id", "class_id", F.coalesce("_n", F.lit(0)).alias("n_links"))


@query("degree_centrality", """--views, d AS (SELECT DISTINCT doc_id, country FROM b_authorships), e AS (SELECT x.country AS a, y.country AS b, count(*) AS w FROM d x JOIN d y ON x.doc_id = y.doc_id AND x.country < y.country GROUP BY ALL),
c AS (SELECT item, count(*) AS degree, sum(w) AS strength FROM (SELECT a AS item, w FROM e UNION ALL SELECT b, w FROM e) GROUP BY item)
SELECT item, degree, strength, round(degree * 1.0 / (count(*) OVER () - 1), 6) AS centrality FROM c""")
def degree_centrality(v: Views) -> DataFrame:
    return graph.degree(_country_edges(v))


def _country_edges(v: Views) -> DataFrame:
    return cooccur.edges(v.authors.select("doc_id", F.col("country").alias("item")))


@query("structural_constraint", """--views, d AS (SELECT DISTINCT doc_id, country FROM b_authorships), e AS (SELECT x.country AS i, y.country AS j, count(*) AS w FROM d x JOIN d y ON x.doc_id = y.doc_id AND x.country <> y.country GROUP BY ALL),
p AS (SELECT i, j, w * 1.0 / sum(w) OVER (PARTITION BY i) AS p FROM e), t AS (SELECT a.i, b.j, sum(a.p * b.p) AS s FROM p a JOIN p b ON b.i = a.j WHERE a.i <> b.j GROUP BY ALL)
SELECT p.i AS item, round(sum((p.p + coalesce(t.s, 0)) * (p.p + coalesce(t.s, 0))), 6) AS "constraint" FROM p LEFT JOIN t ON t.i = p.i AND t.j = p.j GROUP BY p.i""")
def structural_constraint(v: Views) -> DataFrame:
    return graph.constraint(_country_edges(v))


def _unrolled_components(rounds: int) -> str:
    """Each item takes the smallest label around it, then the label of that label; nothing changes any more after a few rounds."""
    steps = [f"{SQL}, n AS MATERIALIZED (SELECT src AS x, dst AS y FROM b_cites UNION SELECT dst, src FROM b_cites), l0 AS MATERIALIZED (SELECT DISTINCT x AS item, x AS c FROM n)"]
    for k in range(rounds):
        steps.append(f"m{k} AS MATERIALIZED (SELECT n.x AS item, least(min(a.c), min(b.c)) AS c FROM n JOIN l{k} a ON a.item = n.x JOIN l{k} b ON b.item = n.y GROUP BY n.x), l{k + 1} AS MATERIALIZED (SELECT m.item, least(m.c, j.c) AS c FROM m{k} m JOIN m{k} j ON j.item = m.c)")
    return ", ".join(steps) + f" SELECT item, c AS component FROM l{rounds}"


@query("components", _unrolled_components(12))
def components(v: Views) -> DataFrame:
    return graph.components(v.cites.select(F.col("src").alias("a"), F.col("dst").alias("b")))


def _unrolled_pagerank(rounds: int) -> str:
    steps = [f"{SQL}, l AS (SELECT DISTINCT src, dst FROM b_cites), o AS MATERIALIZED (SELECT src, count(*) AS d FROM l GROUP BY src), x AS MATERIALIZED (SELECT src AS item FROM l UNION SELECT dst FROM l), n AS (SELECT count(*) AS n FROM x), r0 AS (SELECT item, 1.0 / n AS rank FROM x CROSS JOIN n)"]
    for k in range(rounds):
        steps.append(f"s{k} AS MATERIALIZED (SELECT l.dst AS item, sum(r.rank / o.d) AS s FROM l JOIN o USING (src) JOIN r{k} r ON r.item = l.src GROUP BY l.dst), z{k} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS z FROM r{k} WHERE item NOT IN (SELECT src FROM o)), r{k + 1} AS MATERIALIZED (SELECT x.item, 0.15 / n.n + 0.85 * (coalesce(s.s, 0) + z.z / n.n) AS rank FROM x LEFT JOIN s{k} s USING (item) CROSS JOIN z{k} z CROSS JOIN n)")
    return ", ".join(steps) + f" SELECT item, round(rank * 1000, 6) AS rank FROM r{rounds}"


@query("pagerank", _unrolled_pagerank(20))
def pagerank(v: Views) -> DataFrame:
    return graph.pagerank(v.cites).select("item", F.round(F.col("rank") * 1000, 6).alias("rank"))


@query("salsa")
def salsa(v: Views) -> DataFrame:
    return graph.salsa(v.cites)


@query("salsa_decades")
def salsa_decades(v: Views) -> DataFrame:
    return graph.decade_tops(graph.salsa(v.cites), v.papers.select(F.col("doc_id").alias("item"), "year"))


@query("citation_depth", """--views, e AS (SELECT DISTINCT src, dst FROM b_cites), x AS (SELECT src AS item FROM e UNION SELECT dst FROM e),
c AS (WITH RECURSIVE r(item, depth) AS (SELECT item, 0 FROM x UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.item) SELECT item, max(depth) AS depth FROM r GROUP BY item) SELECT item, depth FROM c""")
def citation_depth(v: Views) -> DataFrame:
    return graph.depths(v.cites)


@query("paper_citations", """WITH n AS (SELECT record_id, trim(regexp_replace(lower(note), 'cited by:?', '', 'g')) AS b FROM papers)
SELECT record_id, CAST(coalesce(CASE WHEN regexp_matches(trim(split_part(b, ';', 1)), '^[0-9]{1,9}$') THEN CAST(trim(split_part(b, ';', 1)) AS INT) END, CAST(nullif(regexp_extract(b, '([0-9]{1,9})', 1), '') AS INT), 0) AS INT) AS citations FROM n""")
def paper_citations(v: Views) -> DataFrame:
    return v.table("papers").select("record_id", ingest.citations(F.col("note")).alias("citations"))


@query("paper_health", "WITH p AS (SELECT " + ", ".join(f"count(*) FILTER (WHERE lower(trim({c})) NOT IN ('', 'unknown')) AS {c}" for c in ("author", "title", "journal", "abstract", "doi")) + ", count(*) AS n FROM papers) SELECT unnest(['author', 'title', 'journal', 'abstract', 'doi']) AS field, unnest([author, title, journal, abstract, doi]) AS n_known, round(100.0 * unnest([author, title, journal, abstract, doi]) / n, 2) AS share FROM p")
def paper_health(v: Views) -> DataFrame:
    return entity.health(v.table("papers"), ["author", "title", "journal", "abstract", "doi"])


@query("first_of_duplicates", """WITH k AS (SELECT record_id, CASE WHEN lower(trim(regexp_replace(doi, '[\\s\\x{00a0}\\x{200b}\\x{feff}]+', ' ', 'g'))) NOT IN ('', 'unknown', 'unkn', 'n/a', 'none', '-') THEN lower(trim(regexp_replace(doi, '[\\s\\x{00a0}\\x{200b}\\x{feff}]+', ' ', 'g'))) END AS d,
trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(title, 'nan')), '[^a-z0-9'' ]+', ' ', 'g'), '[0-9]+', '', 'g'), ' +', ' ', 'g')) AS t FROM papers)
SELECT record_id FROM k WHERE record_id = (SELECT min(record_id) FROM k x WHERE x.t = k.t) AND (d IS NULL OR record_id = (SELECT min(record_id) FROM k x WHERE x.d = k.d))""")
def first_of_duplicates(v: Views) -> DataFrame:
    return select.first_of_duplicates(v.table("papers"), "record_id").select("record_id")


@query("exact_clean_journals", """WITH c AS (SELECT journal AS candidate, count(*) AS n, trim(regexp_replace(regexp_replace(replace(strip_accents(lower(journal)), '&', ' and '), '[''’`]', '', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS k FROM papers WHERE journal IS NOT NULL GROUP BY journal),
b AS (SELECT *, first_value(candidate) OVER (PARTITION BY k ORDER BY n DESC, candidate DESC) AS normalized FROM c WHERE k <> '') SELECT candidate, normalized FROM b WHERE candidate <> normalized""")
def exact_clean_journals(v: Views) -> DataFrame:
    return composite.exact_clean_names(v.table("papers"), "journal")


@query("fuzzy_journals")
def fuzzy_journals(v: Views) -> DataFrame:
    return fuzzy.normalized_entities(v.table("papers"), "journal")


@query("typed_edges", """--views, y AS (SELECT a.doc_id, 'author' AS k, a.author AS x FROM b_authorships a UNION ALL SELECT doc_id, 'keyword', kwa FROM b_keywords UNION ALL SELECT doc_id, 'reference', ref FROM b_references UNION ALL SELECT doc_id, 'journal', journal FROM b_papers)
SELECT 'paper_' || substr(md5(CAST(y.doc_id AS VARCHAR)), 1, 12) AS src, y.k || '_' || substr(md5(lower(trim(y.x))), 1, 12) AS dst, 'paper_' || y.k AS relation, p.year, count(*) AS n FROM y JOIN b_papers p USING (doc_id) GROUP BY ALL""")
def typed_edges(v: Views) -> DataFrame:
    return temporal.typed_edges(v.papers, _attributes(v))


def _attributes(v: Views) -> dict:
    return {"author": (v.authors, "author"), "keyword": (v.keywords, "kwa"), "reference": (v.references, "ref"), "journal": (v.papers, "journal")}


@query("typed_nodes", """--views, y AS (SELECT a.doc_id, 'author' AS k, a.author AS x FROM b_authorships a UNION ALL SELECT doc_id, 'keyword', kwa FROM b_keywords UNION ALL SELECT doc_id, 'reference', ref FROM b_references UNION ALL SELECT doc_id, 'journal', journal FROM b_papers),
e AS (SELECT DISTINCT 'paper_' || substr(md5(CAST(y.doc_id AS VARCHAR)), 1, 12) AS src, y.k || '_' || substr(md5(lower(trim(y.x))), 1, 12) AS dst, p.year FROM y JOIN b_papers p USING (doc_id))
SELECT node, split_part(node, '_', 1) AS kind, count(*) AS degree, min(year) AS first_year, max(year) AS last_year FROM (SELECT src AS node, year FROM e UNION ALL SELECT dst, year FROM e) GROUP BY node""")
def typed_nodes(v: Views) -> DataFrame:
    return temporal.typed_nodes(temporal.typed_edges(v.papers, _attributes(v)))


@query("typed_edges_leading", """--views, t AS (SELECT doc_id FROM b_papers ORDER BY citation DESC, doc_id LIMIT 500), c AS (SELECT doc_id, ref FROM b_references WHERE doc_id IN (SELECT doc_id FROM t)), r AS (SELECT ref FROM (SELECT DISTINCT doc_id, ref FROM c) GROUP BY ref HAVING count(*) >= 2 ORDER BY count(*) DESC, ref LIMIT 300),
y AS (SELECT a.doc_id, 'author' AS k, a.author AS x FROM b_authorships a WHERE doc_id IN (SELECT doc_id FROM t) UNION ALL SELECT doc_id, 'keyword', kwa FROM b_keywords WHERE doc_id IN (SELECT doc_id FROM t) UNION ALL SELECT doc_id, 'reference', ref FROM c WHERE ref IN (SELECT ref FROM r) UNION ALL SELECT doc_id, 'journal', journal FROM b_papers WHERE doc_id IN (SELECT doc_id FROM t))
SELECT 'paper_' || substr(md5(CAST(y.doc_id AS VARCHAR)), 1, 12) AS src, y.k || '_' || substr(md5(lower(trim(y.x))), 1, 12) AS dst, 'paper_' || y.k AS relation, p.year, count(*) AS n FROM y JOIN b_papers p USING (doc_id) GROUP BY ALL""")
def typed_edges_leading(v: Views) -> DataFrame:
    """The graph that a reader looks at: the 500 most cited papers and the 300 references that most of them cite."""
    own = {k: x for k, x in _attributes(v).items() if k != "reference"}
    return temporal.leading_part(v.papers, own, v.references)


@query("reference_indicators", "--views SELECT ref, count(*) AS n, min(year) AS first_year, max(year) AS last_year, max(year) - min(year) AS span FROM (SELECT DISTINCT doc_id, ref FROM b_references) JOIN b_papers USING (doc_id) WHERE year > 0 GROUP BY ref")
def reference_indicators(v: Views) -> DataFrame:
    return temporal.reference_indicators(v.references, v.papers)


@query("internal_references", """WITH r AS (SELECT record_id AS doc_id, unnest(list_distinct(list_filter(list_transform(string_split("references", ';'), lambda v: trim(regexp_replace(v, '[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+', ' ', 'g'))), lambda v: v <> '' AND lower(v) <> 'note' AND NOT regexp_matches(v, '^\\(?[0-9]{4}\\)?$')))) AS ref FROM papers),
q AS (SELECT doc_id, ref, nullif(lower(regexp_extract(ref, '10\\.[0-9]+/\\S+')), '') AS doi, nullif(lower(regexp_extract(ref, '^[\\p{L}''-]+')), '') AS author, nullif(regexp_extract(ref, '\\b(1[6-9][0-9]{2}|20[0-2][0-9])\\b', 1), '') AS year FROM r),
p AS (SELECT record_id AS target, lower(trim(doi)) AS doi, nullif(lower(regexp_extract(author, '^[\\p{L}''-]+')), '') AS author, nullif(regexp_extract(year, '[12][0-9]{3}'), '') AS year FROM papers),
a AS (SELECT q.doc_id, q.ref, min(p.target) AS target FROM q JOIN p ON p.doi = q.doi WHERE q.doc_id <> p.target GROUP BY q.doc_id, q.ref), l AS (SELECT * FROM q ANTI JOIN a ON a.doc_id = q.doc_id AND a.ref = q.ref)
SELECT doc_id, ref, target FROM a UNION ALL SELECT l.doc_id, l.ref, min(p.target) FROM l JOIN p ON p.author = l.author AND p.year = l.year WHERE l.doc_id <> p.target GROUP BY l.doc_id, l.ref""")
def internal_references(v: Views) -> DataFrame:
    """References by the DOI in them, else by first surname and year; titles are not told apart in them."""
    name = lambda c: F.nullif(F.regexp_extract(c, "^[\\p{L}'-]+", 0), F.lit(""))
    papers = v.table("papers")
    refs = papers.select(F.col("record_id").alias("doc_id"), F.explode(F.array_distinct(ingest.split_values(F.col("`references`"), ";", references=True))).alias("ref"))
    found = lambda c, pattern, g: F.nullif(F.regexp_extract(c, pattern, g), F.lit(""))
    parsed = refs.select("doc_id", "ref", found("ref", "10\\.[0-9]+/\\S+", 0).alias("doi"), F.lit(None).cast("string").alias("title"), name("ref").alias("author"), found("ref", "\\b(1[6-9][0-9]{2}|20[0-2][0-9])\\b", 1).alias("year"))
    there = papers.select(F.col("record_id").alias("doc_id"), "doi", F.lit(None).cast("string").alias("title"), name("author").alias("author"), found("year", "[12][0-9]{3}", 0).alias("year"))
    return temporal.internal_references(there, parsed)


_CLEAN = "trim(regexp_replace(regexp_replace(replace(strip_accents(lower(journal)), '&', ' and '), '[''’`]', '', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query("names_applied", f"""WITH c AS (SELECT journal AS candidate, count(*) AS n, {_CLEAN} AS k FROM papers WHERE journal IS NOT NULL GROUP BY journal), b AS (SELECT candidate, first_value(candidate) OVER (PARTITION BY k ORDER BY n DESC, candidate DESC) AS normalized FROM c WHERE k <> '')
SELECT p.record_id, coalesce(b.normalized, p.journal) AS journal FROM papers p LEFT JOIN b ON b.candidate = p.journal""")
def names_applied(v: Views) -> DataFrame:
    papers = v.table("papers")
    return composite.apply_names(papers.select("record_id", "journal"), composite.exact_clean_names(papers, "journal"), "journal")


@query("merged_spellings", "SELECT record_id, CASE WHEN contains(lower(journal), 'proceedings') THEN replace(lower(journal), 'proceedings', 'proc') ELSE lower(journal) END AS journal FROM papers")
def merged_spellings(v: Views) -> DataFrame:
    return select.merge_spellings(v.table("papers").select("record_id", "journal"), "journal", ["Proceedings"], "Proc")


_KINDS = ", ".join("('" + a.replace("'", "''") + "', '" + b + "')" for a, b in ingest.DOCUMENT_TYPES.items())


@query("document_types", f"SELECT p.record_id, coalesce(t.kind, p.document_type) AS document_type FROM papers p LEFT JOIN (VALUES {_KINDS}) t(raw, kind) ON t.raw = p.document_type")
def document_types(v: Views) -> DataFrame:
    return v.table("papers").select("record_id", ingest.document_type(F.col("document_type")).alias("document_type"))


@query("windowed_counts", "SELECT epoch(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')) AS start, event_type AS item, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(v: Views) -> DataFrame:
    return terms.windowed_counts(v.table("events"), "event_type").withColumn("start", F.unix_timestamp("start").cast("double"))


@query("kmeans_projection")
def kmeans_projection(v: Views) -> DataFrame:
    from quillmill.operators import ml

    return ml.clusters(v.table("embeddings"), 10).groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("x"), F.round(F.avg("y"), 4).alias("y"))


@query("lda_topics")
def lda_topics(v: Views) -> DataFrame:
    from quillmill.operators import ml

    return ml.topics(v.table("documents"), 5)


@query("similar_words")
def similar_words(v: Views) -> DataFrame:
    from quillmill.operators import ml

    return ml.similar_words(v.table("documents"), "citation", 10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)
