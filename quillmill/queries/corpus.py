"""Queries on the papers as exported: lists, affiliations, references in texts, profiles, bars, terms and sums, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import clean
from quillmill.operators import citation, composite, crosstab, dynamics, entity, ingest, nested, select, text
from quillmill.queries.bibliometrics import CURRENT_YEAR
from quillmill.queries.records import WORKS
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


# SQL of the functions of columns ----------------------------------------------------------------

_BLANK = "[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+"


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_BLANK}', ' ', 'g'))"


def _missing(x: str) -> str:
    return f"(coalesce(lower({_squeezed(x)}), '') IN ('', 'unknown', 'unkn', 'n/a', 'none', '-'))"


def _split(x: str, references: bool = False) -> str:
    """The values of a cell between semicolons."""
    kept = f"list_filter(list_transform(string_split({x}, ';'), lambda v: {_squeezed('v')}), lambda v: v <> '' AND lower(v) <> 'note')"
    return f"list_filter({kept}, lambda v: NOT regexp_matches(v, '^\\(?[0-9]{{4}}\\)?$'))" if references else kept


def _pieces(x: str, pattern: str) -> str:
    return f"list_transform(regexp_split_to_array(coalesce({x}, ''), '{pattern}'), lambda v: {_squeezed('v')})"


# lists of the papers ----------------------------------------------------------------------------

_REFS = f"""WITH r AS (SELECT record_id AS doc_id, unnest({_split('"references"', True)}) AS ref FROM papers)"""


def _references(v: Views) -> DataFrame:
    """(doc_id, ref): the references of the papers between semicolons, without bare years."""
    return v.table("papers").select(F.col("record_id").alias("doc_id"), F.explode(ingest.split_values(F.col("`references`"), ";", references=True)).alias("ref"))


def _listed(v: Views, column: str) -> DataFrame:
    return v.table("papers").select("record_id", F.posexplode(ingest.split_values(F.col(column), ";")).alias("pos", "item"))


@query("reference_mentions", f"{_REFS} SELECT ref, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM r GROUP BY ref")
def reference_mentions(v: Views) -> DataFrame:
    return _references(v).groupBy("ref").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


_YEARS = ", y AS (SELECT DISTINCT ref, coalesce(list_max(list_filter(list_transform(list_filter(regexp_split_to_array(ref, '[^0-9]+'), lambda t: length(t) = 4), lambda t: CAST(t AS INT)), lambda t: t BETWEEN 1665 AND 2024)), -1) AS year FROM r)"
_COUNTS = ", c AS (SELECT year, count(*) AS n FROM y WHERE year >= 0 GROUP BY year)"


def _reference_years(v: Views) -> DataFrame:
    """(ref, year) of distinct references, by the years in their texts."""
    return _references(v).select("ref", citation.reference_year(F.col("ref"), CURRENT_YEAR).alias("year")).distinct()


@query("reference_years", f"{_REFS}{_YEARS} SELECT year, count(*) AS n FROM y GROUP BY year")
def reference_years(v: Views) -> DataFrame:
    return _reference_years(v).groupBy("year").agg(F.count("*").alias("n"))


@query("rpys_counts", f"{_REFS}{_YEARS}{_COUNTS} SELECT year, n, n - median(n) OVER (ORDER BY year RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS deviation FROM c")
def rpys_counts(v: Views) -> DataFrame:
    return citation.spectroscopy(_reference_years(v))


@query("rpys_smooth", f"""{_REFS}{_YEARS}{_COUNTS}, k AS (SELECT year, n, row_number() OVER (ORDER BY year) - 1 AS k, count(*) OVER () AS m FROM c), o AS (SELECT unnest(range(-4, 5)) AS d),
x AS (SELECT k.year, k.n, o.d, (((k.k + o.d) % (2 * k.m)) + 2 * k.m) % (2 * k.m) AS p, k.m FROM k CROSS JOIN o),
z AS (SELECT x.year, x.n, CAST(floor(sum(exp(-x.d * x.d / 2.0) * k.n) / sum(exp(-x.d * x.d / 2.0)) + 1e-9) AS BIGINT) AS smooth FROM x JOIN k ON k.k = CASE WHEN x.p < x.m THEN x.p ELSE 2 * x.m - 1 - x.p END GROUP BY x.year, x.n)
SELECT year, n, smooth, coalesce(smooth > lag(smooth) OVER (ORDER BY year) AND smooth > lead(smooth) OVER (ORDER BY year) AND smooth >= 1, FALSE) AS peak FROM z""")
def rpys_smooth(v: Views) -> DataFrame:
    return citation.smoothed(citation.spectroscopy(_reference_years(v)).select("year", "n"))


_NAMES = f"a AS (SELECT DISTINCT record_id AS doc_id, split_part(item, ',', 1) AS item FROM (SELECT record_id, unnest({_split('author')}) AS item FROM papers))"


@query("self_citations", f"{_REFS}, {_NAMES}, c AS (SELECT record_id AS doc_id, CAST(coalesce(nullif(regexp_extract(note, '([0-9]{{1,9}})', 1), ''), '0') AS INT) AS c FROM papers), t AS (SELECT item, count(*) AS n_docs, sum(c) AS citations FROM a JOIN c USING (doc_id) GROUP BY item), s AS (SELECT a.item, count(*) AS n FROM a JOIN r USING (doc_id) WHERE contains(lower(r.ref), lower(a.item)) GROUP BY a.item) SELECT t.item, t.n_docs, t.citations, coalesce(s.n, 0) AS n_self FROM t LEFT JOIN s USING (item)")
def self_citations(v: Views) -> DataFrame:
    """Surnames: their papers, citations, and the references of these papers that hold the name."""
    authors = v.table("papers").select(F.col("record_id").alias("doc_id"), F.explode(ingest.split_values(F.col("author"), ";")).alias("item")).select("doc_id", F.element_at(F.split("item", ","), 1).alias("item"))
    papers = v.table("papers").select(F.col("record_id").alias("doc_id"), F.coalesce(F.regexp_extract("note", "([0-9]{1,9})", 1).try_cast("int"), F.lit(0)).alias("citation"))
    totals = entity.presence_counts(authors, papers)
    return totals.join(citation.own_name_citations(authors, _references(v)), "item", "left").fillna(0, ["n_self"])


@query("past_citations", f"""{_REFS}, t AS (SELECT record_id AS target, lower(title) AS t FROM papers WHERE trim(title) <> '' AND lower(trim(title)) <> 'unknown'),
y AS (SELECT record_id AS doc_id, TRY_CAST(regexp_extract(year, '([12][0-9]{{3}})', 1) AS INT) AS year FROM papers), h AS (SELECT DISTINCT r.doc_id, r.ref, t.target FROM r JOIN t ON contains(lower(r.ref), t.t))
SELECT y.year, count(h.target) AS n FROM y LEFT JOIN h USING (doc_id) WHERE y.year IS NOT NULL GROUP BY y.year""")
def past_citations(v: Views) -> DataFrame:
    papers = v.table("papers").select(F.col("record_id").alias("doc_id"), "title", ingest.year_of(F.col("year"), F.lit(None).cast("string")).alias("year"))
    return citation.past_citations(citation.named_title_counts(_references(v), papers.select("doc_id", "title")), papers)


@query("author_institution_pairs", f"""WITH l AS (SELECT record_id, {_split('author')} AS a, {_split('institution')} AS i FROM papers), x AS (SELECT unnest(list_zip(a, i)) AS z FROM l WHERE len(a) = len(i)), y AS (SELECT unnest(a) AS x, i FROM l WHERE len(a) <> len(i))
SELECT x, y, count(*) AS n FROM (SELECT z[1] AS x, z[2] AS y FROM x UNION ALL SELECT x, unnest(i) FROM y) GROUP BY x, y""")
def author_institution_pairs(v: Views) -> DataFrame:
    lists = v.table("papers").select("record_id", ingest.split_values(F.col("author"), ";").alias("a"), ingest.split_values(F.col("institution"), ";").alias("i"))
    return crosstab.zipped(lists, "a", "i", "record_id").groupBy("x", "y").agg(F.count("*").alias("n"))


_PLACES = f"WITH v AS (SELECT record_id, unnest({_split('affiliation')}) AS item FROM papers)"
_RANK = "CASE WHEN regexp_matches(lower(p), 'universi|institut|academ|polytechn') THEN 4 WHEN regexp_matches(lower(p), 'college|laborator|hospital|medical center') THEN 3 WHEN regexp_matches(lower(p), 'cent(?:er|re)|foundation|agency') THEN 2 WHEN regexp_matches(lower(p), 'school|faculty|department|dept') THEN 1 ELSE 0 END"


@query("affiliation_institutions", f"""{_PLACES}, i AS (SELECT DISTINCT item FROM v), q AS (SELECT item, unnest(range(1, len(string_split(item, ',')) + 1)) AS i, unnest(string_split(item, ',')) AS p FROM i),
b AS (SELECT item, trim(p) AS institution, row_number() OVER (PARTITION BY item ORDER BY {_RANK} DESC, length(trim(p)) DESC, i) AS k FROM q) SELECT b.institution, count(*) AS n FROM v JOIN b ON b.item = v.item AND b.k = 1 GROUP BY b.institution""")
def affiliation_institutions(v: Views) -> DataFrame:
    return ingest.detected_institutions(_listed(v, "affiliation")).groupBy("institution").agg(F.count("*").alias("n"))


@query("affiliation_countries", f"""{_PLACES}, k AS (SELECT DISTINCT country, lower(upper(regexp_replace(country, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))) AS k FROM name_forms WHERE country IS NOT NULL)
SELECT k.country, count(*) AS n FROM v JOIN k ON k.k = lower(upper(regexp_replace(string_split(v.item, ',')[-1], '[^\\p{{L}}\\p{{N}}]+', '', 'g'))) GROUP BY k.country""")
def affiliation_countries(v: Views) -> DataFrame:
    names = v.table("name_forms").where("country is not null").select("country").distinct()
    return ingest.detected_countries(_listed(v, "affiliation"), names).groupBy("country").agg(F.count("*").alias("n"))


# affiliations with their authors, by vendor -----------------------------------------------------


@query("affiliations_pubmed", f"""WITH l AS (SELECT record_id, {_pieces('author', ' and ')} AS a, {_pieces('affiliation', ';')} AS b FROM papers)
SELECT record_id, array_to_string(list_transform(b, lambda x, i: CASE WHEN i <= len(a) THEN a[i] || ' ' || x ELSE x END), '; ') AS affiliation FROM l""")
def affiliations_pubmed(v: Views) -> DataFrame:
    return v.table("papers").select("record_id", ingest.author_affiliations(F.col("author"), F.col("affiliation")).alias("affiliation"))


_PEOPLE = "\\s+and\\s+|;"


@query("affiliations_scopus", f"""WITH l AS (SELECT record_id, {_pieces('author', _PEOPLE)} AS a, {_pieces('affiliation', ';')} AS b, string_split(coalesce(correspondence_address1, ''), ';') AS c FROM papers),
k AS (SELECT *, coalesce(len(c) > 1 AND trim(c[2]) <> '' AND trim(c[1]) <> '' AND upper(trim(c[1])) <> 'UNKNOWN', FALSE) AS known, trim(c[2]) AS addr FROM l),
h AS (SELECT *, CASE WHEN known THEN {_pieces('c[1]', '\\s+and\\s+')} ELSE [] END AS heads FROM k),
o AS (SELECT record_id, known, heads, addr, list_filter(a, lambda x: NOT list_contains(heads, x)) AS a, list_filter(b, lambda x: NOT known OR NOT contains(lower(x), lower(addr))) AS b FROM h)
SELECT record_id, array_to_string(list_concat(CASE WHEN known THEN [heads[1] || ' ' || addr] ELSE [] END, list_transform(b[1:least(len(a), len(b))], lambda x, i: a[i] || ' ' || x)), '; ') AS affiliation FROM o""")
def affiliations_scopus(v: Views) -> DataFrame:
    return v.table("papers").select("record_id", ingest.scopus_affiliations(F.col("author"), F.col("affiliation"), F.col("correspondence_address1")).alias("affiliation"))


@query("affiliations_wos", "SELECT record_id, replace(regexp_replace(translate(regexp_replace(affiliation, '([A-Z])\\.', '\\1#', 'g'), ';.', ',;'), ';+$', ''), '#', '.') AS affiliation FROM papers")
def affiliations_wos(v: Views) -> DataFrame:
    return v.table("papers").select("record_id", ingest.wos_affiliations(F.col("affiliation")).alias("affiliation"))


@query("keyword_lists", "SELECT record_id, replace(author_keywords, ',', ';') AS author_keywords, regexp_extract(doi, '^[0-9a-zA-Z./_:-]*') AS doi, TRY_CAST(nullif(regexp_extract(year, '([12][0-9]{3})', 1), '') AS INT) AS year FROM papers")
def keyword_lists(v: Views) -> DataFrame:
    """Keywords between semicolons, the usable beginning of the DOI, and the year as a number."""
    return v.table("papers").select("record_id", ingest.keyword_list(F.col("author_keywords")).alias("author_keywords"), clean.doi_characters(F.col("doi")).alias("doi"), ingest.year_of(F.col("year"), F.lit(None).cast("string")).alias("year"))


@query("paper_labels", "SELECT record_id, author || ' (' || year || '). ' || title || '. ' || journal || '. doi:' || doi || '.' AS label FROM papers")
def paper_labels(v: Views) -> DataFrame:
    return v.table("papers").select("record_id", ingest.label(*(F.col(c) for c in ("author", "year", "title", "journal", "doi"))).alias("label"))


@query("filled_countries", f"""WITH l AS (SELECT record_id, {_split('country')} AS c FROM papers), x AS (SELECT record_id, unnest(range(0, len(c))) AS pos, unnest(c) AS c FROM l)
SELECT record_id, CAST(pos AS INT) AS pos, coalesce(last_value(nullif(c, 'UNKNOWN') IGNORE NULLS) OVER (PARTITION BY record_id ORDER BY pos), 'UNKNOWN') AS item FROM x""")
def filled_countries(v: Views) -> DataFrame:
    return ingest.filled_forward(_listed(v, "country"), "item", group="record_id")


_STAMPS = ("updated_at", "loaded_at")


def _union_sql() -> str:
    texts = "author title year journal abbrev_source_title volume pages doi url affiliation abstract author_keywords keywords references correspondence_address1 publisher issn language document_type note source institution country openalex_id".split()
    cols = ", ".join(f"""coalesce("{c}", 'UNKNOWN') AS "{c}\"""" for c in texts) + ", " + ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in _STAMPS)
    return f"""WITH f AS (SELECT record_id, {cols}, CASE WHEN coalesce(lower(trim(source)) IN ('scopus', 'scopus export'), FALSE) THEN 0 ELSE 1 END AS n_ FROM papers),
k AS (SELECT *, CASE WHEN NOT {_missing('doi')} THEN lower({_squeezed('doi')}) END AS d_, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9'' ]+', ' ', 'g'), '[0-9]+', '', 'g'), ' +', ' ', 'g')) AS t_ FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY t_ ORDER BY n_, record_id) AS a_, row_number() OVER (PARTITION BY d_ ORDER BY n_, record_id) AS b_ FROM k) SELECT * EXCLUDE (n_, d_, t_, a_, b_) FROM o WHERE a_ = 1 AND (d_ IS NULL OR b_ = 1)"""


@query("union_corpora", _union_sql())
def union_corpora(v: Views) -> DataFrame:
    """The export of one vendor is the old corpus, all other sources are the new one; times as texts."""
    papers = v.table("papers")
    vendor = F.coalesce(F.lower(F.trim("source")).isin("scopus", "scopus export"), F.lit(False))
    both = select.union_corpora(papers.where(vendor), papers.where(~vendor), "record_id")
    return both.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in _STAMPS})


# nested works -----------------------------------------------------------------------------------


@query("openalex_edges", WORKS + """, n AS (SELECT work_id, w ->> '$.display_name' AS title, row_number() OVER (PARTITION BY work_id ORDER BY loaded_at DESC NULLS LAST, w ->> '$.doi' DESC NULLS LAST, w ->> '$.display_name' DESC NULLS LAST) AS n FROM w), o2 AS (SELECT work_id, title FROM n WHERE n = 1),
l AS (SELECT work_id, CASE json_type(w, '$.referenced_works') WHEN 'ARRAY' THEN list_transform(from_json(json_extract(w, '$.referenced_works'), '["JSON"]'), lambda x: x ->> '$') WHEN 'VARCHAR' THEN list_filter(regexp_split_to_array(w ->> '$.referenced_works', '[;,|\\s]+'), lambda x: x <> '') END AS r FROM w),
e AS (SELECT DISTINCT work_id, upper(regexp_extract(trim(x), '(?i)^(?:.*[/:\\s])?(w\\d+)/?$', 1)) AS item FROM (SELECT work_id, unnest(r) AS x FROM l) WHERE regexp_matches(trim(x), '(?i)^(?:.*[/:\\s])?w\\d+/?$'))
SELECT e.work_id AS source_id, e.item AS target_id, a.title AS source_title, b.title AS target_title FROM e JOIN o2 a ON a.work_id = e.work_id JOIN o2 b ON b.work_id = e.item""")
def openalex_edges(v: Views) -> DataFrame:
    return nested.openalex_edges(v.table("works_raw"))


@query("openalex_reference_table", WORKS + """, l AS (SELECT work_id, CASE json_type(w, '$.referenced_works') WHEN 'ARRAY' THEN list_transform(from_json(json_extract(w, '$.referenced_works'), '["JSON"]'), lambda x: x ->> '$') WHEN 'VARCHAR' THEN list_filter(regexp_split_to_array(w ->> '$.referenced_works', '[;,|\\s]+'), lambda x: x <> '') END AS r FROM w),
e AS (SELECT DISTINCT work_id, upper(regexp_extract(trim(x), '(?i)^(?:.*[/:\\s])?(w\\d+)/?$', 1)) AS item FROM (SELECT work_id, unnest(r) AS x FROM l) WHERE regexp_matches(trim(x), '(?i)^(?:.*[/:\\s])?w\\d+/?$')), k AS (SELECT DISTINCT work_id FROM w)
SELECT e.work_id AS citing_work_id, e.item AS cited_work_id, e.item IN (SELECT work_id FROM k) AS inside FROM e""")
def openalex_reference_table(v: Views) -> DataFrame:
    return nested.openalex_references(v.table("works_raw")).select("citing_work_id", "cited_work_id", "inside")


# references as keys -----------------------------------------------------------------------------


@query("citing_papers_of_references", "--views SELECT DISTINCT r.ref, r.doc_id, p.year FROM b_references r JOIN b_papers p USING (doc_id) WHERE p.year BETWEEN 1996 AND 1998")
def citing_papers(v: Views) -> DataFrame:
    return citation.citing_papers(v.references, v.papers, (1996, 1998))


@query("co_cited_triples", """--views, d AS (SELECT DISTINCT doc_id, ref FROM b_references), c AS (SELECT a.ref || '|' || b.ref || '|' || c.ref AS refs, count(*) AS n FROM d a JOIN d b ON b.doc_id = a.doc_id AND b.ref > a.ref JOIN d c ON c.doc_id = a.doc_id AND c.ref > b.ref GROUP BY 1) SELECT refs, n FROM c ORDER BY n DESC, refs LIMIT 10""")
def co_cited_triples(v: Views) -> DataFrame:
    return citation.co_cited_groups(v.references, 3, 10)


@query("self_citation_rates", """--views, d AS (SELECT DISTINCT doc_id, lower(trim(author)) AS a FROM b_authorships), s AS (SELECT DISTINCT c.src, c.dst FROM b_cites c JOIN d x ON x.doc_id = c.src JOIN d y ON y.doc_id = c.dst AND y.a = x.a)
SELECT c.src AS doc_id, count(*) AS n_refs, round(avg(CASE WHEN s.src IS NULL THEN 0 ELSE 1 END), 6) AS rate FROM (SELECT DISTINCT src, dst FROM b_cites) c LEFT JOIN s ON s.src = c.src AND s.dst = c.dst GROUP BY c.src""")
def self_citation_rates(v: Views) -> DataFrame:
    return citation.self_citation_rates(v.cites, v.authors.select("doc_id", F.col("author").alias("item")))


@query("top_references_window", "--views SELECT ref, count(*) AS n FROM b_references JOIN b_papers USING (doc_id) WHERE year BETWEEN 1995 AND 1997 GROUP BY ref ORDER BY n DESC, ref LIMIT 25")
def top_references_window(v: Views) -> DataFrame:
    span = v.papers.where("year between 1995 and 1997").select("doc_id")
    return citation.top_references(v.references.join(span, "doc_id", "left_semi"), 25)


# bars, sums and profiles ------------------------------------------------------------------------


@query("institutions_per_docs", "--views SELECT region AS item, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM b_authorships GROUP BY region")
def institutions_per_docs(v: Views) -> DataFrame:
    m = v.authors.select("doc_id", F.col("region").alias("item"))
    return entity.presence(m).groupBy("item").agg(F.count("*").alias("n_docs")).join(entity.mention_counts(m), "item")


def _cited(column: str, table: str) -> str:
    return f"--views SELECT x AS item, count(*) AS n_docs, sum(citation) AS citations FROM (SELECT DISTINCT doc_id, {column} AS x FROM {table}) JOIN b_papers USING (doc_id) GROUP BY x"


@query("institutions_per_citations", _cited("region", "b_authorships"))
def institutions_per_citations(v: Views) -> DataFrame:
    return entity.presence_counts(v.authors, v.papers, "region")


@query("countries_per_citations", _cited("country", "b_authorships"))
def countries_per_citations(v: Views) -> DataFrame:
    return entity.presence_counts(v.authors, v.papers, "country")


@query("keywords_plus_per_docs", _cited("kwp", "b_keywords"))
def keywords_plus_per_docs(v: Views) -> DataFrame:
    return entity.presence_counts(v.keywords, v.papers, "kwp")


@query("productivity_institution", "--views SELECT region AS item, year, count(*) AS n FROM b_authorships JOIN b_papers USING (doc_id) GROUP BY region, year")
def productivity_institution(v: Views) -> DataFrame:
    return entity.productivity(v.authors, v.papers, "region", once=False)


@query("doc_type_ids", "--views SELECT document_type, doc_id FROM b_papers WHERE document_type IS NOT NULL")
def doc_type_ids(v: Views) -> DataFrame:
    return v.papers.where("document_type is not null").select("document_type", "doc_id")


@query("filter_positions", "--views SELECT doc_id, year FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM b_papers) WHERE p IN (0, 7, 100, 1400)")
def filter_positions(v: Views) -> DataFrame:
    return select.at_positions(v.papers, "doc_id", [0, 7, 100, 1400]).select("doc_id", "year")


@query("filter_sources", "--views SELECT doc_id, journal FROM b_papers WHERE journal IN ('j_1', 'j_7', 'j_40')")
def filter_sources(v: Views) -> DataFrame:
    return select.filter_papers(v.papers, sources=["j_1", "j_7", "j_40"]).select("doc_id", "journal")


def _core_sql(zones: str) -> str:
    return f"""--views, c AS (SELECT journal AS item, count(*) AS n FROM b_papers GROUP BY journal), t AS (SELECT sum(n) AS t FROM c), z AS (SELECT item, sum(n) OVER (ORDER BY n DESC, item ROWS UNBOUNDED PRECEDING) AS r FROM c),
b AS (SELECT item, CASE WHEN r <= t.t // 3 THEN 1 WHEN r <= 2 * t.t // 3 THEN 2 ELSE 3 END AS zone FROM z CROSS JOIN t) SELECT p.doc_id, p.journal FROM b_papers p JOIN b ON b.item = p.journal WHERE b.zone IN ({zones})"""


for _code, _zones in ((1, "1"), (2, "2"), (3, "3"), (23, "2, 3")):

    def _core(v: Views, code: int = _code) -> DataFrame:
        return select.filter_papers(v.papers, core=code).select("doc_id", "journal")

    query(f"filter_core_{_code}", _core_sql(_zones))(_core)


@query("filter_abstract", f"SELECT record_id FROM papers WHERE NOT {_missing('abstract')}")
def filter_abstract(v: Views) -> DataFrame:
    return select.filter_papers(v.table("papers"), abstract=True).select("record_id")


_H = "SELECT author, max(CASE WHEN citation >= rn THEN rn ELSE 0 END) AS h FROM (SELECT author, citation, row_number() OVER (PARTITION BY author ORDER BY citation DESC, doc_id) AS rn FROM (SELECT DISTINCT doc_id, author FROM b_authorships) JOIN b_papers USING (doc_id)) GROUP BY author"


@query("eda_averages", f"""--views, n AS (SELECT count(*) AS docs, sum(citation) AS c, count(DISTINCT journal) AS j, max(year) - min(year) + 1 AS y FROM b_papers), a AS (SELECT count(DISTINCT author) AS a, count(DISTINCT region) AS i, count(DISTINCT (doc_id, author)) AS ad, count(DISTINCT (doc_id, region)) AS id FROM b_authorships),
k AS (SELECT doc_id, count(DISTINCT author) AS k FROM b_authorships GROUP BY doc_id), m AS (SELECT count(*) FILTER (WHERE k > 1) AS multi, avg(k) AS team FROM k), h AS (SELECT max(h) AS h FROM ({_H}))
SELECT unnest(['documents_per_author', 'documents_per_institution', 'documents_per_source', 'documents_per_year', 'citations_per_author', 'citations_per_institution', 'citations_per_document', 'citations_per_source', 'multi_author_documents', 'authors_per_document', 'max_h_index']) AS kpi,
unnest([round(ad * 1.0 / a, 2), round(id * 1.0 / i, 2), round(docs * 1.0 / j, 2), round(docs * 1.0 / y, 2), round(c * 1.0 / a, 2), round(c * 1.0 / i, 2), round(c * 1.0 / docs, 2), round(c * 1.0 / j, 2), CAST(multi AS DOUBLE), round(team, 2), CAST(h AS DOUBLE)]) AS value FROM n, a, m, h""")
def eda_averages(v: Views) -> DataFrame:
    return entity.averages(v.authors.select("doc_id", F.col("author").alias("item")), v.authors.select("doc_id", F.col("region").alias("item")), v.papers)


@query("health_report", "WITH p AS (SELECT " + ", ".join(f"""count(*) FILTER (WHERE lower(trim("{c}")) NOT IN ('', 'unknown')) AS "{c}\"""" for c in entity.HEALTH) + ", count(*) AS n FROM papers) SELECT unnest([" + ", ".join(f"'{c}'" for c in entity.HEALTH) + "]) AS field, unnest([" + ", ".join(f'"{c}"' for c in entity.HEALTH) + "]) AS n_known, round(100.0 * unnest([" + ", ".join(f'"{c}"' for c in entity.HEALTH) + "]) / n, 2) AS share FROM p")
def health_report(v: Views) -> DataFrame:
    return entity.health(v.table("papers"), list(entity.HEALTH))


def _profile_sql(table: str, column: str, name: str, others: dict[str, tuple[str, str]]) -> str:
    out = f"--views, o AS (SELECT DISTINCT doc_id FROM {table} WHERE {column} = '{name}'), p AS (SELECT * FROM b_papers WHERE doc_id IN (SELECT doc_id FROM o))"
    out += " SELECT 'n_docs' AS kind, '' AS value, count(*) AS n FROM p UNION ALL SELECT 'citations', '', coalesce(sum(citation), 0) FROM p UNION ALL SELECT 'first_year', '', min(year) FROM p UNION ALL SELECT 'last_year', '', max(year) FROM p"
    for kind, (t, c) in others.items():
        out += f" UNION ALL SELECT '{kind}', {c}, count(DISTINCT doc_id) FROM {t} WHERE doc_id IN (SELECT doc_id FROM o) AND {c} <> '{name}' GROUP BY {c}"
    return out


#: Profiles: the view, the column, the entity, and what it is met with.
_PROFILES = {
    "affiliation": ("authors", "region", "AFRICA", ("country", "kwa", "journal")), "country": ("authors", "country", "NATION_3", ("author", "kwa", "journal")), "journal": ("papers", "journal", "j_1", ("author", "country", "kwa")),
    "keyword": ("keywords", "kwa", "brand#13", ("kwa", "country", "journal")), "keyword_plus": ("keywords", "kwp", "economy", ("kwp", "country", "journal")), "reference": ("references", "ref", "r_1", ("ref", "author", "country")),
}
_WHERE = {"region": "authors", "country": "authors", "author": "authors", "kwa": "keywords", "kwp": "keywords", "journal": "papers", "ref": "references"}
_TABLES = {"authors": "b_authorships", "keywords": "b_keywords", "papers": "b_papers", "references": "b_references"}

for _kind, (_view, _column, _name, _met) in _PROFILES.items():

    def _profile(v: Views, view: str = _view, column: str = _column, name: str = _name, met: tuple[str, ...] = _met) -> DataFrame:
        rows = lambda c: getattr(v, _WHERE[c]).select("doc_id", F.col(c).alias("item"))
        return composite.profile(rows(column), v.papers, name, {c: rows(c) for c in met})

    query(f"profile_{_kind}", _profile_sql(_TABLES[_view], _column, _name, {c: (_TABLES[_WHERE[c]], c) for c in _met}))(_profile)


@query("profile_author_indices", f"""--views, r AS (SELECT citation, year, row_number() OVER (ORDER BY citation DESC, doc_id) AS rn, sum(citation) OVER (ORDER BY citation DESC, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT DISTINCT doc_id FROM b_authorships WHERE author = 'Supplier#000000001') JOIN b_papers USING (doc_id)),
h AS (SELECT coalesce(max(CASE WHEN citation >= rn THEN rn END), 0) AS h, coalesce(max(CASE WHEN cum >= rn * rn THEN rn END), 0) AS g FROM r), d AS (SELECT unnest([500, 250, 100, 50, 25, 10, 5, 4, 3, 2, 1.5, 1.25]) AS d, unnest(range(1, 13)) AS k),
j AS (SELECT sum(1.0 / d.k * (SELECT count(*) FROM r WHERE r.citation >= h.h * d.d)) / (SELECT sum(1.0 / k) FROM d) AS j FROM d CROSS JOIN h), e AS (SELECT sqrt(sum(CASE WHEN r.rn <= h.h THEN greatest(r.citation - h.h, 0) ELSE 0 END)) AS e FROM r CROSS JOIN h)
SELECT unnest(['h_index', 'g_index', 'e_index', 'j_index']) AS kind, '' AS value, unnest([CAST(h AS DOUBLE), CAST(g AS DOUBLE), round(e, 2), round(CASE WHEN h > 0 THEN h + j ELSE 0 END, 2)]) AS n FROM h, j, e""")
def profile_author_indices(v: Views) -> DataFrame:
    return composite.profile_indices(v.authors.select("doc_id", F.col("author").alias("item")), v.papers, "Supplier#000000001", CURRENT_YEAR)


_STATS = "--views, s AS (SELECT author AS item, count(*) AS n_docs, sum(citation) AS citations, avg(citation) AS impact FROM (SELECT DISTINCT doc_id, author FROM b_authorships) JOIN b_papers USING (doc_id) GROUP BY author)"
_QUADRANT = "CASE WHEN n_docs >= p AND {i} >= i THEN 'Stars' WHEN {i} >= i THEN 'Emerging' WHEN n_docs >= p THEN 'Mature/Core' ELSE 'Marginal' END AS quadrant"


def _stats(v: Views) -> DataFrame:
    return entity.presence_counts(v.authors, v.papers, "author").withColumn("impact", F.col("citations") / F.col("n_docs"))


@query("portfolio_means", f"{_STATS}, m AS (SELECT avg(n_docs) AS p, avg(impact) AS i FROM s) SELECT item, n_docs, round(impact, 6) AS impact, {_QUADRANT.format(i='impact')} FROM s CROSS JOIN m")
def portfolio_means(v: Views) -> DataFrame:
    return composite.portfolio(_stats(v).select("item", "n_docs", "impact"), cuts="mean").withColumn("impact", F.round("impact", 6))


@query("portfolio_h", f"{_STATS}, h AS ({_H}) SELECT s.item, s.n_docs, h.h, {_QUADRANT.replace('p ', '40 ').replace('>= i', '>= 12').format(i='h.h')} FROM s JOIN h ON h.author = s.item")
def portfolio_h(v: Views) -> DataFrame:
    """Impact is the h-index; the cuts are given."""
    h = entity.h_index(v.authors, v.papers, "author")
    return composite.portfolio(_stats(v).select("item", "n_docs").join(h, "item"), impact="h", cuts=(40, 12))


@query("portfolio_leading", f"{_STATS}, z AS (SELECT item, n_docs, citations, round((n_docs - avg(n_docs) OVER ()) / (stddev_pop(n_docs) OVER () + 1e-12) + (citations - avg(citations) OVER ()) / (stddev_pop(citations) OVER () + 1e-12), 9) AS z FROM s) SELECT item, n_docs, citations FROM z ORDER BY z DESC, item LIMIT 10")
def portfolio_leading(v: Views) -> DataFrame:
    return composite.leading(_stats(v).select("item", "n_docs", "citations"), 10, impact="citations")


# terms over time --------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query("term_growth_sources", f"""WITH y AS (SELECT record_id AS doc_id, TRY_CAST(nullif(regexp_extract(year, '([12][0-9]{{3}})', 1), '') AS INT) AS year FROM papers), k AS (SELECT record_id AS doc_id, unnest({_split('author_keywords')}) AS item FROM papers),
w AS (SELECT record_id AS doc_id, unnest(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))) AS item FROM papers WHERE title IS NOT NULL),
o AS (SELECT DISTINCT doc_id, lower(trim(item)) AS item FROM (SELECT * FROM k UNION ALL SELECT * FROM w) WHERE lower(trim(item)) NOT IN ('', 'unknown')), c AS (SELECT item, year, count(*) AS n FROM o JOIN y USING (doc_id) WHERE year IS NOT NULL GROUP BY ALL),
t AS (SELECT item FROM c GROUP BY item ORDER BY sum(n) DESC, item LIMIT 8), s AS (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM y)
SELECT t.item, CAST(s.year AS INT) AS year, coalesce(c.n, 0) AS n, CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY t.item ORDER BY s.year) AS BIGINT) AS total FROM t CROSS JOIN s LEFT JOIN c ON c.item = t.item AND c.year = s.year""")
def term_growth_sources(v: Views) -> DataFrame:
    """Author keywords and words of titles together."""
    papers = v.table("papers").select(F.col("record_id").alias("doc_id"), ingest.year_of(F.col("year"), F.lit(None).cast("string")).alias("year")).where("year is not null")
    keys = _listed(v, "author_keywords").select(F.col("record_id").alias("doc_id"), "item")
    words = v.table("papers").where("title is not null").select(F.col("record_id").alias("doc_id"), F.explode(text.tokens(F.col("title"))).alias("item"))
    return dynamics.term_growth(dynamics.union_terms([keys, words]), papers, 8)


_SERIES = """WITH RECURSIVE e AS (SELECT dayofyear(ts) AS y, event_id, event_type || ':' || (user_id % 20) AS item FROM events), f AS (SELECT item FROM e GROUP BY item HAVING count(*) >= 5), b AS (SELECT min(y) AS y0, max(y) AS y1 FROM e),
d AS (SELECT x.y, count(DISTINCT e.event_id) AS d FROM (SELECT unnest(range(y0, y1 + 1)) AS y FROM b) x LEFT JOIN e USING (y) GROUP BY x.y), r AS (SELECT f.item, d.y, d.d, count(DISTINCT e.event_id) AS r FROM f CROSS JOIN d LEFT JOIN e ON e.item = f.item AND e.y = d.y GROUP BY ALL),
p AS (SELECT item, least(sum(r) * 1.0 / sum(d), 0.999) AS p0, least(0.999, 2 * (sum(r) * 1.0 / sum(d))) AS p1 FROM r GROUP BY item),
c AS MATERIALIZED (SELECT r.item, r.y, -(r.r * ln(p0) + (r.d - r.r) * ln(1 - p0)) AS c0, -(r.r * ln(p1) + (r.d - r.r) * ln(1 - p1)) AS c1, row_number() OVER (PARTITION BY r.item ORDER BY r.y) AS t FROM r JOIN p USING (item)),
v(item, t, b0, b1, m0, m1) AS (SELECT item, t, c0, c1 + 1, 0, 0 FROM c WHERE t = 1 UNION ALL SELECT c.item, c.t, least(v.b0, v.b1) + c.c0, least(v.b0 + 1, v.b1) + c.c1, CASE WHEN v.b1 < v.b0 THEN 1 ELSE 0 END, CASE WHEN v.b1 < v.b0 + 1 THEN 1 ELSE 0 END FROM v JOIN c ON c.item = v.item AND c.t = v.t + 1),
w AS MATERIALIZED (SELECT * FROM v), l AS (SELECT max(t) AS t FROM w),
s(item, t, z) AS (SELECT w.item, w.t, CASE WHEN w.b1 < w.b0 THEN 1 ELSE 0 END FROM w JOIN l USING (t) UNION ALL SELECT w.item, w.t - 1, CASE WHEN s.z = 1 THEN w.m1 ELSE w.m0 END FROM s JOIN w ON w.item = s.item AND w.t = s.t WHERE s.t > 1),
g AS (SELECT s.item, c.y, c.c0 - c.c1 AS x, s.t - row_number() OVER (PARTITION BY s.item ORDER BY s.t) AS g FROM s JOIN c USING (item, t) WHERE s.z = 1)"""


@query("bursts", f"{_SERIES} SELECT item, CAST(min(y) AS INT) AS first_year, CAST(max(y) AS INT) AS last_year, round(sum(x), 6) AS strength FROM g GROUP BY item, g")
def bursts(v: Views) -> DataFrame:
    days = v.table("events").select(F.col("event_id").alias("doc_id"), F.dayofyear("ts").alias("year"), F.concat_ws(":", "event_type", (F.col("user_id") % 20).cast("string")).alias("item"))
    return dynamics.bursts(days.select("doc_id", "item"), days.select("doc_id", "year"), least=5).withColumn("strength", F.round("strength", 6))


@query("parsed_evolution", """--views, c AS (SELECT year, term AS item, count(*) AS n FROM b_keywords JOIN b_papers USING (doc_id) GROUP BY ALL), t AS (SELECT year, item, n FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, item) AS place FROM c) WHERE place <= 5),
b AS (SELECT item FROM t GROUP BY item ORDER BY sum(n) DESC, item LIMIT 10) SELECT y.year, b.item, coalesce(t.n, 0) AS n FROM (SELECT DISTINCT year FROM t) y CROSS JOIN b LEFT JOIN t ON t.year = y.year AND t.item = b.item""")
def parsed_evolution(v: Views) -> DataFrame:
    """The report of the top terms of each year, written as a text and read again."""
    best = dynamics.top_terms_each_year(v.keywords.select("doc_id", F.col("term").alias("item")), v.papers, 5)
    entry = F.concat("item", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    years = best.groupBy("year").agg(F.concat(F.col("year").cast("string"), F.lit(": "), F.array_join(F.sort_array(F.collect_list(entry)), ", ")).alias("y"))
    return dynamics.parsed_evolution(years.agg(F.array_join(F.sort_array(F.collect_list("y")), " ").alias("text")))


@query("event_sessions", "WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN b IS NULL OR ts - b >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def event_sessions(v: Views) -> DataFrame:
    found = terms.sessions(v.table("events"), "user_id")
    return found.select("user_id", F.unix_micros("start").alias("start"), "n")


@query("event_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def event_first_seen(v: Views) -> DataFrame:
    return terms.first_seen(v.table("events"), ["user_id", "event_type"]).select("user_id", "event_type")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)
