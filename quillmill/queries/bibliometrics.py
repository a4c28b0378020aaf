"""Bibliometric queries over the analytic tables seen as a corpus (see sources/views.py), each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import citation, composite, cooccur, crosstab, dynamics, entity, select
from quillmill.sources.views import SQL, Views

#: The year in which indices are taken.
CURRENT_YEAR = 2024

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the views under ``name``, with SQL that follows the views' definitions."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        _Q[name] = lambda spark, folder: f(Views(spark, folder))
        if sql is not None:
            _S[name] = sql.replace("--views", SQL)
        return f

    return add


def _items(v: Views, kind: str) -> DataFrame:
    """(doc_id, item) mentions of authors, countries, keywords (kwa, kwp, term)."""
    source = v.authors if kind in ("author", "country", "region") else v.keywords
    return source.select("doc_id", F.col(kind).alias("item"))


@query("author_metrics", """--views, pc AS (SELECT DISTINCT doc_id, author FROM b_authorships),
r AS (SELECT author, citation, year, row_number() OVER (PARTITION BY author ORDER BY citation DESC, doc_id) AS rn,
  sum(citation) OVER (PARTITION BY author ORDER BY citation DESC, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM pc JOIN b_papers USING (doc_id)),
h AS (SELECT author, coalesce(max(CASE WHEN citation >= rn THEN rn END), 0) AS h, coalesce(max(CASE WHEN cum >= rn * rn THEN rn END), 0) AS g, min(year) AS y0 FROM r GROUP BY author),
d AS (SELECT unnest([500, 250, 100, 50, 25, 10, 5, 4, 3, 2, 1.5, 1.25]) AS d, unnest(range(1, 13)) AS k),
j AS (SELECT h.author, sum(1.0 / d.k * (SELECT count(*) FROM r WHERE r.author = h.author AND r.citation >= h.h * d.d)) AS s FROM h CROSS JOIN d GROUP BY h.author)
SELECT h.author AS item, h.h, h.g, round(sqrt(sum(CASE WHEN r.rn <= h.h THEN greatest(r.citation - h.h, 0) ELSE 0 END)), 6) AS e,
round(h.h * 1.0 / greatest(1, 2024 - h.y0 + 1), 6) AS m, round(CASE WHEN h.h > 0 THEN h.h + any_value(j.s) / (SELECT sum(1.0 / k) FROM d) ELSE 0 END, 6) AS j
FROM h JOIN r USING (author) JOIN j USING (author) GROUP BY h.author, h.h, h.g, h.y0""")
def author_metrics(v: Views) -> DataFrame:
    out = entity.impact_indices(_items(v, "author"), v.papers, CURRENT_YEAR)
    return out.select("item", "h", "g", F.round("e", 6).alias("e"), F.round("m", 6).alias("m"), F.round("j", 6).alias("j"))


@query("top_authors_by_h", """--views, pc AS (SELECT DISTINCT doc_id, author FROM b_authorships),
r AS (SELECT author, citation, row_number() OVER (PARTITION BY author ORDER BY citation DESC, doc_id) AS rn FROM pc JOIN b_papers USING (doc_id))
SELECT author AS item, max(CASE WHEN citation >= rn THEN rn ELSE 0 END) AS h FROM r GROUP BY author ORDER BY h DESC, item LIMIT 20""")
def top_authors_by_h(v: Views) -> DataFrame:
    return entity.top(entity.h_index(_items(v, "author"), v.papers), "h", 20)


@query("country_h_mentions", """--views, r AS (SELECT country, citation, row_number() OVER (PARTITION BY country ORDER BY citation DESC, doc_id) AS rn FROM b_authorships JOIN b_papers USING (doc_id))
SELECT country AS item, max(CASE WHEN citation >= rn THEN rn ELSE 0 END) AS h FROM r GROUP BY country""")
def country_h_mentions(v: Views) -> DataFrame:
    return entity.h_index(_items(v, "country"), v.papers, once=False)


@query("entity_mentions", "--views SELECT author AS item, count(*) AS n FROM b_authorships GROUP BY author")
def entity_mentions(v: Views) -> DataFrame:
    return entity.mention_counts(_items(v, "author"))


@query("entity_presence", "--views SELECT author AS item, count(*) AS n_docs, sum(citation) AS citations FROM (SELECT DISTINCT doc_id, author FROM b_authorships) JOIN b_papers USING (doc_id) GROUP BY author")
def entity_presence(v: Views) -> DataFrame:
    return entity.presence_counts(_items(v, "author"), v.papers)


@query("countries_per_docs", "--views SELECT country AS item, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM b_authorships GROUP BY country")
def countries_per_docs(v: Views) -> DataFrame:
    m = _items(v, "country")
    return entity.presence(m).groupBy("item").agg(F.count("*").alias("n_docs")).join(entity.mention_counts(m), "item")


@query("per_year", """--views, s AS (SELECT CAST(unnest(range(min(year), max(year) + 1)) AS INT) AS year FROM b_papers)
SELECT s.year, count(p.doc_id) AS n_docs, coalesce(sum(p.citation), 0) AS citations FROM s LEFT JOIN b_papers p USING (year) GROUP BY s.year""")
def per_year(v: Views) -> DataFrame:
    return entity.per_year(v.papers)


@query("doc_types", "--views SELECT document_type, count(*) AS n FROM b_papers GROUP BY document_type")
def doc_types(v: Views) -> DataFrame:
    return v.papers.groupBy("document_type").agg(F.count("*").alias("n"))


@query("languages_per_docs", "--views SELECT language AS item, count(*) AS n FROM b_papers GROUP BY language")
def languages_per_docs(v: Views) -> DataFrame:
    return entity.mention_counts(v.papers, "language")


@query("lotka", "--views SELECT n_docs, count(*) AS n_authors FROM (SELECT author, count(DISTINCT doc_id) AS n_docs FROM b_authorships GROUP BY author) GROUP BY n_docs")
def lotka(v: Views) -> DataFrame:
    return entity.lotka(_items(v, "author"))


_BRADFORD = """, c AS (SELECT journal AS item, count(*) AS n_docs FROM b_papers GROUP BY journal), t AS (SELECT sum(n_docs) AS t FROM c),
z AS (SELECT item, n_docs, sum(n_docs) OVER (ORDER BY n_docs DESC, item ROWS UNBOUNDED PRECEDING) AS running FROM c),
b AS (SELECT item, n_docs, running, CASE WHEN running <= t.t // 3 THEN 1 WHEN running <= 2 * t.t // 3 THEN 2 ELSE 3 END AS zone FROM z CROSS JOIN t)
"""


@query("bradford_zones", f"--views {_BRADFORD} SELECT item, n_docs, CAST(running AS BIGINT) AS running, zone FROM b")
def bradford_zones(v: Views) -> DataFrame:
    return entity.bradford(v.papers)


@query("filter_core_12", f"--views {_BRADFORD} SELECT p.doc_id, p.year, p.journal FROM b_papers p JOIN b ON b.item = p.journal WHERE b.zone IN (1, 2)")
def filter_core(v: Views) -> DataFrame:
    return select.filter_papers(v.papers, core=12).select("doc_id", "year", "journal")


@query("filter_combined", "--views SELECT doc_id, year, citation FROM b_papers WHERE document_type IN ('F', 'O') AND year >= 1996 AND year <= 1998 AND language IN ('1-URGENT', '5-LOW')")
def filter_combined(v: Views) -> DataFrame:
    return select.filter_papers(v.papers, doc_types=["F", "O"], years=(1996, 1998), languages=["1-URGENT", "5-LOW"]).select("doc_id", "year", "citation")


@query("filter_any_country", "--views SELECT doc_id, year FROM b_papers p WHERE EXISTS (SELECT 1 FROM b_authorships a WHERE a.doc_id = p.doc_id AND a.country IN ('NATION_3', 'NATION_7'))")
def filter_any_country(v: Views) -> DataFrame:
    return select.with_any(v.papers, v.authors, ["NATION_3", "NATION_7"], "country").select("doc_id", "year")


@query("top_sources_by_citations", "--views SELECT journal AS item, sum(citation) AS citations FROM b_papers GROUP BY journal ORDER BY citations DESC, item LIMIT 20")
def top_sources_by_citations(v: Views) -> DataFrame:
    return entity.top(v.papers.groupBy(F.col("journal").alias("item")).agg(F.sum("citation").alias("citations")), "citations", 20)


@query("treemap_keywords", "--views SELECT kwa AS item, count(*) AS n FROM b_keywords GROUP BY kwa ORDER BY n DESC, item LIMIT 15")
def treemap_keywords(v: Views) -> DataFrame:
    return entity.top(entity.mention_counts(_items(v, "kwa")), "n", 15)


@query("team_sizes", """--views, k AS (SELECT doc_id, count(DISTINCT author) AS n_authors FROM b_authorships GROUP BY doc_id)
SELECT year, n_authors, count(*) AS n_docs FROM k JOIN b_papers USING (doc_id) GROUP BY GROUPING SETS ((year, n_authors), (n_authors))""")
def team_sizes(v: Views) -> DataFrame:
    return entity.team_sizes(_items(v, "author"), v.papers)


@query("collaboration_index", """--views, k AS (SELECT doc_id, count(DISTINCT author) AS n_authors FROM b_authorships GROUP BY doc_id),
c AS (SELECT year, n_authors, count(*) AS n FROM k JOIN b_papers USING (doc_id) GROUP BY GROUPING SETS ((year, n_authors), (n_authors))),
p AS (SELECT n_authors, row_number() OVER (ORDER BY n_authors) AS p FROM (SELECT DISTINCT n_authors FROM c))
SELECT year, round(sum(p * n) * 1.0 / sum(n), 2) AS ci FROM c JOIN p USING (n_authors) GROUP BY year""")
def collaboration_index(v: Views) -> DataFrame:
    return entity.collaboration_index(_items(v, "author"), v.papers)


@query("eda_report", """--views, a AS (SELECT count(*) AS n, count(DISTINCT author) AS d, count(DISTINCT country) AS c FROM b_authorships), p AS (SELECT count(*) AS n, min(year) AS y0, max(year) AS y1, sum(citation) AS c, count(DISTINCT journal) AS j FROM b_papers),
k AS (SELECT count(DISTINCT kwa) AS a, count(DISTINCT kwp) AS p FROM b_keywords), r AS (SELECT count(*) AS n, count(DISTINCT ref) AS d FROM b_references),
s AS (SELECT count(*) AS solo FROM (SELECT doc_id FROM b_authorships GROUP BY doc_id HAVING count(DISTINCT author) = 1))
SELECT unnest(['documents', 'first_year', 'last_year', 'citations', 'sources', 'author_mentions', 'authors', 'countries', 'author_keywords', 'keywords_plus', 'reference_mentions', 'references', 'single_author_documents']) AS kpi,
unnest([CAST(p.n AS BIGINT), p.y0, p.y1, p.c, p.j, a.n, a.d, a.c, k.a, k.p, r.n, r.d, s.solo]) AS value FROM a, p, k, r, s""")
def eda_report(v: Views) -> DataFrame:
    p = v.papers.agg(F.count("*").alias("documents"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum("citation").alias("citations"), F.countDistinct("journal").alias("sources"))
    a = v.authors.agg(F.count("*").alias("author_mentions"), F.countDistinct("author").alias("authors"), F.countDistinct("country").alias("countries"))
    k = v.keywords.agg(F.countDistinct("kwa").alias("author_keywords"), F.countDistinct("kwp").alias("keywords_plus"))
    r = v.references.agg(F.count("*").alias("reference_mentions"), F.countDistinct("ref").alias("references"))
    s = entity.presence(_items(v, "author")).groupBy("doc_id").count().agg(F.count_if(F.col("count") == 1).alias("single_author_documents"))
    parts = [x.select(F.inline(F.array(*(F.struct(F.lit(c).alias("kpi"), F.col(c).cast("bigint").alias("value")) for c in x.columns)))) for x in (p, a, k, r, s)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("productivity_author", "--views SELECT author AS item, year, count(DISTINCT doc_id) AS n FROM b_authorships JOIN b_papers USING (doc_id) GROUP BY author, year")
def productivity_author(v: Views) -> DataFrame:
    return entity.productivity(_items(v, "author"), v.papers)


@query("productivity_country", "--views SELECT country AS item, year, count(*) AS n FROM b_authorships JOIN b_papers USING (doc_id) GROUP BY country, year")
def productivity_country(v: Views) -> DataFrame:
    return entity.productivity(_items(v, "country"), v.papers, once=False)


@query("productivity_source", "--views SELECT journal AS item, year, count(*) AS n FROM b_papers GROUP BY journal, year")
def productivity_source(v: Views) -> DataFrame:
    return v.papers.groupBy(F.col("journal").alias("item"), "year").agg(F.count("*").alias("n"))



@query("count_y_per_x", """--views, j AS (SELECT a.country AS x, k.kwa AS y FROM b_authorships a JOIN b_keywords k USING (doc_id) WHERE a.pos = 0),
u AS (SELECT x FROM j GROUP BY x ORDER BY count(*) DESC, x LIMIT 5), c AS (SELECT x, y, count(*) AS n FROM j WHERE x IN (SELECT x FROM u) GROUP BY x, y),
r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY n DESC, y) AS r FROM c) SELECT x, y, n FROM r WHERE r <= 4""")
def count_y_per_x(v: Views) -> DataFrame:
    first = v.authorships.where("pos = 0").select("doc_id", "country")
    return crosstab.count_y_per_x(first.join(v.keywords.select("doc_id", "kwa"), "doc_id"), "country", "kwa", 5, 4)


@query("heatmap_y_per_x", """--views, j AS (SELECT a.doc_id, a.country AS x, k.kwp AS y FROM b_authorships a JOIN b_keywords k USING (doc_id)),
u AS (SELECT x FROM j GROUP BY x ORDER BY count(*) DESC, x LIMIT 6), w AS (SELECT y FROM j GROUP BY y ORDER BY count(*) DESC, y LIMIT 4)
SELECT x, y, count(DISTINCT doc_id) AS n_docs FROM j WHERE x IN (SELECT x FROM u) AND y IN (SELECT y FROM w) GROUP BY x, y""")
def heatmap_y_per_x(v: Views) -> DataFrame:
    pairs = v.authors.select("doc_id", "country").join(v.keywords.select("doc_id", "kwp"), "doc_id")
    return crosstab.heatmap(pairs, "country", "kwp", 6, 4)


@query("sankey_flows", """--views, j AS (SELECT a.region, a.country, p.document_type FROM b_authorships a JOIN b_papers p USING (doc_id)),
a1 AS (SELECT region FROM j GROUP BY region ORDER BY count(*) DESC, region LIMIT 3), j1 AS (SELECT * FROM j WHERE region IN (SELECT region FROM a1)),
a2 AS (SELECT country FROM j1 GROUP BY country ORDER BY count(*) DESC, country LIMIT 3), j2 AS (SELECT * FROM j1 WHERE country IN (SELECT country FROM a2)),
a3 AS (SELECT document_type FROM j2 GROUP BY document_type ORDER BY count(*) DESC, document_type LIMIT 3), j3 AS (SELECT * FROM j2 WHERE document_type IN (SELECT document_type FROM a3))
SELECT 1 AS level, region AS source, country AS target, count(*) AS n FROM j2 GROUP BY ALL UNION ALL SELECT 2, country, document_type, count(*) FROM j3 GROUP BY ALL""")
def sankey_flows(v: Views) -> DataFrame:
    rows = v.authors.select("doc_id", "region", "country").join(v.papers.select("doc_id", "document_type"), "doc_id")
    return crosstab.flows(rows, ["region", "country", "document_type"], 3)


@query("coauthor_edges", """--views, d AS (SELECT DISTINCT doc_id, author FROM b_authorships)
SELECT x.author AS a, y.author AS b, count(*) AS w FROM d x JOIN d y ON x.doc_id = y.doc_id AND x.author < y.author GROUP BY ALL HAVING count(*) >= 2""")
def coauthor_edges(v: Views) -> DataFrame:
    return cooccur.edges(_items(v, "author"), least=2)


@query("country_edges", """--views, d AS (SELECT DISTINCT doc_id, country FROM b_authorships)
SELECT x.country AS a, y.country AS b, count(*) AS w FROM d x JOIN d y ON x.doc_id = y.doc_id AND x.country < y.country GROUP BY ALL""")
def country_edges(v: Views) -> DataFrame:
    return cooccur.edges(_items(v, "country"))


@query("country_position_edges", """--views SELECT x.country AS a, y.country AS b, count(*) AS w FROM b_authorships x JOIN b_authorships y ON x.doc_id = y.doc_id AND x.pos <> y.pos GROUP BY ALL""")
def country_position_edges(v: Views) -> DataFrame:
    return cooccur.position_edges(_items(v, "country"))


@query("keyword_partners", """--views, d AS (SELECT DISTINCT doc_id, kwa FROM b_keywords), e AS (SELECT x.kwa AS a, y.kwa AS b, count(*) AS w FROM d x JOIN d y ON x.doc_id = y.doc_id AND x.kwa < y.kwa GROUP BY ALL)
SELECT item, count(*) AS n_partners, sum(w) AS strength FROM (SELECT a AS item, w FROM e UNION ALL SELECT b, w FROM e) GROUP BY item""")
def keyword_partners(v: Views) -> DataFrame:
    return cooccur.partners(cooccur.edges(_items(v, "kwa")))


@query("collab_ego", """--views, d AS (SELECT DISTINCT doc_id, country FROM b_authorships), t AS (SELECT country FROM b_authorships GROUP BY country ORDER BY count(*) DESC, country LIMIT 3)
SELECT x.country AS item, y.country AS partner, count(*) AS w FROM d x JOIN d y ON x.doc_id = y.doc_id AND x.country <> y.country WHERE x.country IN (SELECT country FROM t) GROUP BY ALL""")
def collab_ego(v: Views) -> DataFrame:
    m = _items(v, "country")
    return cooccur.ego(cooccur.edges(m), entity.top(entity.mention_counts(m), "n", 3))


#: Papers by their references: _ONE names each class with equal counts (or, _SET, the same references) by its smallest id.
_ONE = ", c AS (SELECT doc_id, ref, count(*) AS n FROM b_references GROUP BY ALL), k AS (SELECT doc_id, list_sort(list(ref || '#' || n)) AS l FROM c GROUP BY doc_id), o AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY l) AS class_id FROM k)"
_SET = _ONE.replace("ref || '#' || n", "ref")


@query("bibliographic_coupling", f"""--views {_ONE}, u AS (SELECT * FROM c WHERE doc_id IN (SELECT class_id FROM o)), m AS (SELECT doc_id, sqrt(sum(n * n)) AS l FROM u GROUP BY doc_id),
d AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared, sum(x.n * y.n) AS dot FROM u x JOIN u y ON x.ref = y.ref AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a, b, shared, round(dot / (x.l * y.l), 6) AS cosine FROM d JOIN m x ON x.doc_id = a JOIN m y ON y.doc_id = b WHERE dot / (x.l * y.l) >= 0.3""")
def bibliographic_coupling(v: Views) -> DataFrame:
    return cooccur.coupling(v.references, 0.3)


@query("coupling_classes", f"--views {_ONE} SELECT doc_id, class_id FROM o")
def coupling_classes(v: Views) -> DataFrame:
    """Which paper stands for each paper in ``bibliographic_coupling``."""
    return cooccur.reference_classes(v.references)


@query("shared_references", f"""--views {_SET}, u AS (SELECT * FROM c WHERE doc_id IN (SELECT class_id FROM o))
SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM u x JOIN u y ON x.ref = y.ref AND x.doc_id < y.doc_id GROUP BY ALL HAVING count(*) >= 2""")
def shared_references(v: Views) -> DataFrame:
    return cooccur.shared_references(v.references, 2)


@query("shared_reference_classes", f"--views {_SET} SELECT doc_id, class_id FROM o")
def shared_reference_classes(v: Views) -> DataFrame:
    """Which paper stands for each paper in ``shared_references``."""
    return cooccur.reference_classes(v.references, once=True)


@query("co_cited_pairs", """--views, c AS (SELECT DISTINCT doc_id, ref FROM b_references)
SELECT x.ref AS a, y.ref AS b, count(*) AS w FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.ref < y.ref GROUP BY ALL HAVING count(*) >= 2""")
def co_cited_pairs(v: Views) -> DataFrame:
    return cooccur.edges(v.references.select("doc_id", F.col("ref").alias("item")), least=2)


@query("co_citation_ego", """--views SELECT ref, count(DISTINCT doc_id) AS n FROM b_references WHERE doc_id IN (SELECT doc_id FROM b_references WHERE ref = 'r_1') AND ref <> 'r_1' GROUP BY ref""")
def co_citation_ego(v: Views) -> DataFrame:
    return cooccur.cocited_with(v.references, "r_1")


@query("reference_incidence", """--views, c AS (SELECT doc_id, ref, count(*) AS n FROM b_references GROUP BY ALL) SELECT doc_id, ref, n FROM c WHERE ref IN (SELECT ref FROM c GROUP BY ref HAVING sum(n) >= 40)""")
def reference_incidence(v: Views) -> DataFrame:
    return cooccur.incidence(v.references, 40)


@query("top_references", "--views SELECT ref, count(*) AS n FROM b_references GROUP BY ref ORDER BY n DESC, ref LIMIT 25")
def top_references(v: Views) -> DataFrame:
    return citation.top_references(v.references, 25)


@query("citation_trajectory", """--views, s AS (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM b_papers), r AS (SELECT DISTINCT ref FROM b_references WHERE ref IN ('r_1', 'r_2', 'r_3')),
c AS (SELECT ref, year, count(*) AS n FROM b_references JOIN b_papers USING (doc_id) GROUP BY ALL)
SELECT r.ref, CAST(s.year AS INT) AS year, coalesce(c.n, 0) AS n, CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY r.ref ORDER BY s.year) AS BIGINT) AS total FROM r CROSS JOIN s LEFT JOIN c ON c.ref = r.ref AND c.year = s.year""")
def citation_trajectory(v: Views) -> DataFrame:
    return citation.trajectory(v.references, v.papers, ["r_1", "r_2", "r_3"])


@query("local_citation_edges", "--views SELECT src, dst, src_year, dst_year FROM b_cites WHERE src <> dst")
def local_citation_edges(v: Views) -> DataFrame:
    return citation.local_citations(v.references, v.papers)


@query("historiograph_nodes", """--views SELECT doc_id, sum(i) AS n_cited, sum(o) AS n_citing FROM (SELECT dst AS doc_id, 1 AS i, 0 AS o FROM b_cites UNION ALL SELECT src, 0, 1 FROM b_cites) GROUP BY doc_id""")
def historiograph_nodes(v: Views) -> DataFrame:
    return citation.historiograph(v.cites)


@query("sleeping_beauties", """--views, y AS (SELECT min(year) AS y0, max(year) AS y1 FROM b_papers), n AS (SELECT ref, year, count(*) AS n FROM b_references JOIN b_papers USING (doc_id) GROUP BY ALL),
s AS (SELECT r.ref, t.y - y.y0 AS t, coalesce(n.n, 0) AS c FROM (SELECT DISTINCT ref FROM n) r CROSS JOIN y CROSS JOIN (SELECT unnest(range(y0, y1 + 1)) AS y FROM y) t LEFT JOIN n ON n.ref = r.ref AND n.year = t.y),
m AS (SELECT ref, max(c) AS cm, sum(c) AS total FROM s GROUP BY ref), q AS (SELECT s.ref, any_value(m.cm) AS cm, any_value(m.total) AS total, min(s.t) AS tm FROM s JOIN m USING (ref) WHERE s.c = m.cm GROUP BY s.ref),
z AS (SELECT q.*, s.c AS c0 FROM q JOIN s ON s.ref = q.ref AND s.t = 0 WHERE q.tm > 0 AND q.total >= 10),
d AS (SELECT z.*, s.t, ((cm - c0) * 1.0 / tm * s.t + c0 - s.c) / greatest(1, s.c) AS part, sqrt((cm - c0) * (cm - c0) + greatest(1, tm * tm)) AS l, round(abs((cm - c0) * s.t - tm * s.c + tm * c0) / sqrt((cm - c0) * (cm - c0) + greatest(1, tm * tm)), 9) AS far FROM z JOIN s ON s.ref = z.ref AND s.t <= z.tm),
f AS (SELECT ref, sum(part) AS b, any_value(l) AS l, max(far) AS far, any_value(c0) AS c0, any_value(cm) AS cm, any_value(tm) AS tm, any_value(total) AS total FROM d GROUP BY ref HAVING sum(part) > 0)
SELECT f.ref, round(f.b, 6) AS b, round(f.b / f.l, 6) AS sbi, min(d.t) AS awakening, f.c0, f.cm, f.tm, f.total FROM f JOIN d ON d.ref = f.ref AND d.far = f.far GROUP BY ALL""")
def sleeping_beauties(v: Views) -> DataFrame:
    return citation.sleeping_beauties(v.references, v.papers, 10)


@query("princes", """--views, i AS (SELECT x.dst AS beauty, y.dst AS prince, count(*) AS n FROM b_cites x JOIN b_cites y ON y.src = x.src JOIN b_cites z ON z.dst = x.dst AND z.src = y.dst GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY beauty ORDER BY n DESC, prince) AS r FROM i) SELECT beauty, prince, n FROM r WHERE r = 1""")
def princes(v: Views) -> DataFrame:
    cites = v.cites
    return citation.princes(cites, cites.select(F.col("dst").alias("beauty")).distinct())


@query("reference_diversity", """--views, x AS (SELECT c.src, c.src_year - c.dst_year AS age, p.journal FROM b_cites c JOIN b_papers p ON p.doc_id = c.dst),
s AS (SELECT src, journal, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT src, sum(n) AS t, count(*) AS k, sum(n * ln(n)) AS z FROM s GROUP BY src),
a AS (SELECT src, count(*) AS n_refs, avg(age) AS m, stddev_pop(age) AS d FROM x GROUP BY src)
SELECT src AS doc_id, n_refs, round(m, 6) AS mean_age, round(d, 6) AS std_age, round(greatest(0, ln(t) - z / t), 6) AS entropy, round(CASE WHEN k > 1 THEN greatest(0, ln(t) - z / t) / ln(k) ELSE 0 END, 6) AS evenness FROM a JOIN t USING (src)""")
def reference_diversity(v: Views) -> DataFrame:
    return citation.reference_diversity(v.cites, v.papers)


@query("disruption_index", """--views, r AS (SELECT DISTINCT src FROM b_cites), c AS (SELECT dst AS focal, src AS citer FROM b_cites),
o AS (SELECT DISTINCT x.src AS focal, y.src AS citer FROM b_cites x JOIN b_cites y ON y.dst = x.dst WHERE y.src_year > x.src_year AND y.src <> x.src),
m AS (SELECT coalesce(c.focal, o.focal) AS focal, c.citer IS NOT NULL AS f, o.citer IS NOT NULL AS g FROM c FULL JOIN o ON o.focal = c.focal AND o.citer = c.citer),
k AS (SELECT focal, count(*) FILTER (WHERE NOT g) AS ni, count(*) FILTER (WHERE f AND g) AS nj, count(*) FILTER (WHERE NOT f) AS nk FROM m GROUP BY focal)
SELECT focal AS doc_id, ni, nj, nk, round((ni - nj) * 1.0 / (ni + nj + nk), 6) AS di FROM k WHERE focal IN (SELECT src FROM r) AND ni + nj >= 1""")
def disruption_index(v: Views) -> DataFrame:
    return citation.disruption(v.cites)


@query("term_growth", """--views, o AS (SELECT DISTINCT doc_id, term FROM b_keywords), c AS (SELECT term, year, count(*) AS n FROM o JOIN b_papers USING (doc_id) GROUP BY ALL),
t AS (SELECT term FROM c GROUP BY term ORDER BY sum(n) DESC, term LIMIT 8), s AS (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM b_papers)
SELECT t.term AS item, CAST(s.year AS INT) AS year, coalesce(c.n, 0) AS n, CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY t.term ORDER BY s.year) AS BIGINT) AS total FROM t CROSS JOIN s LEFT JOIN c ON c.term = t.term AND c.year = s.year""")
def term_growth(v: Views) -> DataFrame:
    return dynamics.term_growth(_items(v, "term"), v.papers, 8)


@query("term_evolution_top", """--views, c AS (SELECT year, term AS item, count(*) AS n FROM b_keywords JOIN b_papers USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, item) AS place FROM c) SELECT year, item, n, place FROM r WHERE place <= 5""")
def term_evolution_top(v: Views) -> DataFrame:
    return dynamics.top_terms_each_year(_items(v, "term"), v.papers, 5)


@query("first_adoption", """--views, u AS (SELECT k.kwa AS concept, a.country AS entity, min(p.year) AS first_year FROM b_authorships a JOIN b_keywords k USING (doc_id) JOIN b_papers p USING (doc_id) GROUP BY ALL)
SELECT concept, entity, first_year, first_year - min(first_year) OVER (PARTITION BY concept) AS delay FROM u""")
def first_adoption(v: Views) -> DataFrame:
    return dynamics.first_adoption(v.authors.select("doc_id", F.col("country").alias("entity")), v.keywords.select("doc_id", F.col("kwa").alias("concept")), v.papers)


@query("concept_flows", """--views, o AS (SELECT DISTINCT doc_id, kwa FROM b_keywords), x AS (SELECT c.src, c.dst, c.src_year - c.dst_year AS d, count(*) AS k FROM b_cites c JOIN o a ON a.doc_id = c.dst JOIN o b ON b.doc_id = c.src AND b.kwa = a.kwa GROUP BY ALL)
SELECT s.region AS source, t.region AS target, CAST(sum(k) AS BIGINT) AS n, round(sum(k * d) * 1.0 / sum(k), 2) AS mean_delay FROM x JOIN b_authorships s ON s.doc_id = x.dst JOIN b_authorships t ON t.doc_id = x.src WHERE s.region <> t.region GROUP BY ALL""")
def concept_flows(v: Views) -> DataFrame:
    regions = v.authors.select("doc_id", F.col("region").alias("entity"))
    return dynamics.concept_flows(v.cites, regions, v.keywords.select("doc_id", F.col("kwa").alias("concept")))


@query("portfolio_quadrants", """--views, s AS (SELECT author AS item, count(*) AS n_docs, avg(citation) AS impact FROM (SELECT DISTINCT doc_id, author FROM b_authorships) JOIN b_papers USING (doc_id) GROUP BY author),
m AS (SELECT median(n_docs) AS p, median(impact) AS i FROM s)
SELECT item, n_docs, round(impact, 6) AS impact, CASE WHEN n_docs >= p AND impact >= i THEN 'Stars' WHEN impact >= i THEN 'Emerging' WHEN n_docs >= p THEN 'Mature/Core' ELSE 'Marginal' END AS quadrant FROM s CROSS JOIN m""")
def portfolio_quadrants(v: Views) -> DataFrame:
    stats = entity.presence_counts(_items(v, "author"), v.papers).select("item", "n_docs", (F.col("citations") / F.col("n_docs")).alias("impact"))
    return composite.portfolio(stats).withColumn("impact", F.round("impact", 6))


@query("specialization_index", """--views, e AS (SELECT DISTINCT doc_id, country FROM b_authorships), f AS (SELECT DISTINCT doc_id, kwa FROM b_keywords),
te AS (SELECT country FROM e GROUP BY country ORDER BY count(*) DESC, country LIMIT 15), tf AS (SELECT kwa FROM f GROUP BY kwa ORDER BY count(*) DESC, kwa LIMIT 15),
c AS (SELECT country, kwa, count(*) AS n FROM e JOIN f USING (doc_id) WHERE country IN (SELECT country FROM te) AND kwa IN (SELECT kwa FROM tf) GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY country) AS r, sum(n) OVER (PARTITION BY kwa) AS k, sum(n) OVER () AS t FROM c), a AS (SELECT *, (n * 1.0 / r) / (k * 1.0 / t) AS ai FROM m)
SELECT country AS entity, kwa AS field, n, round(ai, 4) AS ai, round((ai - 1) / (ai + 1), 4) AS si, round(n * 1.0 / r, 4) AS share FROM a""")
def specialization_index(v: Views) -> DataFrame:
    return composite.specialization(_items(v, "country"), _items(v, "kwa"), 15)


@query("collaboration_impact", """--views, d AS (SELECT DISTINCT doc_id, author FROM b_authorships), k AS (SELECT doc_id, count(*) AS k FROM d GROUP BY doc_id), x AS (SELECT d.author, k.k, p.citation FROM d JOIN k USING (doc_id) JOIN b_papers p USING (doc_id)),
g AS (SELECT author AS item, count(*) AS n_docs, count(*) FILTER (WHERE k = 1) AS n_solo, count(*) FILTER (WHERE k > 1) AS n_collab, avg(citation) FILTER (WHERE k = 1) AS s, avg(citation) FILTER (WHERE k > 1) AS c FROM x GROUP BY author)
SELECT item, n_docs, n_solo, n_collab, round(n_collab * 1.0 / n_docs, 6) AS rate, round(s, 6) AS mean_solo, round(c, 6) AS mean_collab, round(CASE WHEN s > 0 THEN c / s END, 6) AS ratio FROM g""")
def collaboration_impact(v: Views) -> DataFrame:
    return composite.collaboration_impact(_items(v, "author"), v.papers)


@query("profile_author", """--views, o AS (SELECT DISTINCT doc_id FROM b_authorships WHERE author = 'Supplier#000000001'), p AS (SELECT * FROM b_papers WHERE doc_id IN (SELECT doc_id FROM o))
SELECT 'n_docs' AS kind, '' AS value, count(*) AS n FROM p UNION ALL SELECT 'citations', '', coalesce(sum(citation), 0) FROM p UNION ALL SELECT 'first_year', '', min(year) FROM p UNION ALL SELECT 'last_year', '', max(year) FROM p
UNION ALL SELECT 'coauthor', author, count(DISTINCT doc_id) FROM b_authorships WHERE doc_id IN (SELECT doc_id FROM o) AND author <> 'Supplier#000000001' GROUP BY author
UNION ALL SELECT 'keyword', kwa, count(DISTINCT doc_id) FROM b_keywords WHERE doc_id IN (SELECT doc_id FROM o) GROUP BY kwa""")
def profile_author(v: Views) -> DataFrame:
    m = _items(v, "author")
    return composite.profile(m, v.papers, "Supplier#000000001", {"coauthor": m, "keyword": _items(v, "kwa")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)
