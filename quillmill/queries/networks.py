"""Queries on the graphs of the corpus, each with SQL whose rounds are unrolled or recursive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import citation, composite, cooccur, entity, graph, temporal
from quillmill.plans import checkpointed
from quillmill.sources.views import SQL, Views

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        _Q[name] = lambda spark, folder: f(Views(spark, folder))
        if sql is not None:
            _S[name] = sql.replace("--views", SQL)
        return f

    return add


#: Country pairs as (x, y, w) in both directions; author pairs; the author pairs above the mean weight.
_COUNTRIES = ", d AS (SELECT DISTINCT doc_id, country FROM b_authorships), e AS MATERIALIZED (SELECT a.country AS x, b.country AS y, count(*) AS w FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.country <> b.country GROUP BY ALL)"
_AUTHORS = ", d AS (SELECT DISTINCT doc_id, author FROM b_authorships), g AS MATERIALIZED (SELECT a.author AS a, b.author AS b, count(*) AS w FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.author < b.author GROUP BY ALL)"
_BOTH = ", e AS MATERIALIZED (SELECT a AS x, b AS y, w FROM g UNION ALL SELECT b, a, w FROM g)"
_STRONG = _AUTHORS + ", h AS (SELECT * FROM g WHERE w >= 2), s AS (SELECT a, b, w FROM h WHERE w > (SELECT avg(w) FROM h))" + _BOTH.replace("FROM g", "FROM s")


def _distances(levels: int) -> str:
    """t (s, v, c, d): the number c of shortest paths and the distance d of all pairs of (x, y) in e, d up to ``levels``."""
    steps = ["l1 AS MATERIALIZED (SELECT DISTINCT x AS s, y AS v, CAST(1 AS DOUBLE) AS c, 1 AS d FROM e)"]
    for k in range(1, levels):
        seen = " UNION ALL ".join(f"SELECT s, v FROM l{j}" for j in range(1, k + 1))
        steps.append(f"l{k + 1} AS MATERIALIZED (SELECT l.s, e.y AS v, sum(l.c) AS c, {k + 1} AS d FROM l{k} l JOIN (SELECT DISTINCT x, y FROM e) e ON e.x = l.v WHERE e.y <> l.s AND NOT EXISTS (SELECT 1 FROM ({seen}) z WHERE z.s = l.s AND z.v = e.y) GROUP BY l.s, e.y)")
    return ", " + ", ".join(steps) + ", t AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(1, levels + 1)) + ")"


#: The sum over pairs of the share of shortest paths through a node.
_BETWEEN = ", b AS (SELECT p.v AS item, sum(p.c * q.c / t.c) AS b FROM t p JOIN t q ON q.s = p.v JOIN t ON t.s = p.s AND t.v = q.v WHERE p.d + q.d = t.d GROUP BY p.v)"


def _author_edges(v: Views) -> DataFrame:
    return cooccur.edges(v.authors.select("doc_id", F.col("author").alias("item")))


def _strong_authors(v: Views) -> DataFrame:
    """The co-author graph cut by weight at its mean, as the whole graph is complete at small scale."""
    edges = cooccur.edges(v.authors.select("doc_id", F.col("author").alias("item")), least=2)
    return edges.crossJoin(F.broadcast(edges.agg(F.avg("w").alias("_m")))).where("w > _m").drop("_m")  # one row


def _country_edges(v: Views) -> DataFrame:
    return cooccur.edges(v.authors.select("doc_id", F.col("country").alias("item")))


def _powers(rounds: int, katz: bool) -> str:
    """The rounds of a power iteration, or of Katz centrality with alpha 0.01 on edges of weight 1."""
    steps = [f"{SQL}{_COUNTRIES}, r0 AS MATERIALIZED (SELECT DISTINCT x AS item, CAST(1 AS DOUBLE) AS r FROM e)"]
    for k in range(rounds):
        moved = f"SELECT e.y AS item, sum(r.r * {1 if katz else 'e.w'}) AS r FROM e JOIN r{k} r ON r.item = e.x GROUP BY e.y"
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT item, {'0.01 * r + 1' if katz else 'r / sqrt(sum(r * r) OVER ())'} AS r FROM ({moved}))")
    return ", ".join(steps) + f" SELECT item, round(r / sqrt(sum(r * r) OVER ()), 6) AS score FROM r{rounds}"


@query("eigenvector_centrality", _powers(15, False))
def eigenvector(v: Views) -> DataFrame:
    return graph.power_iteration(_country_edges(v), rounds=15)


@query("katz_centrality", _powers(15, True))
def katz(v: Views) -> DataFrame:
    return graph.power_iteration(_country_edges(v).withColumn("w", F.lit(1)), rounds=15, katz=0.01)


@query("betweenness", f"--views{_STRONG}{_distances(6)}{_BETWEEN}, n AS (SELECT DISTINCT x AS item FROM e) SELECT n.item, round(coalesce(b.b, 0) / greatest((count(*) OVER () - 1) * (count(*) OVER () - 2), 1), 6) AS betweenness FROM n LEFT JOIN b USING (item)")
def betweenness(v: Views) -> DataFrame:
    return graph.betweenness(_strong_authors(v))


def _loads(levels: int) -> str:
    """x (s, v, l): what each node gets and sends on if every node sends one unit to s, from the farthest level to the nearest."""
    steps = ["z AS (SELECT s, v, d FROM t UNION ALL SELECT DISTINCT s, s, 0 FROM t)", "np AS MATERIALIZED (SELECT t.s, t.v, count(*) AS k FROM t JOIN e ON e.y = t.v JOIN z ON z.s = t.s AND z.v = e.x AND z.d = t.d - 1 GROUP BY t.s, t.v)", f"x{levels} AS MATERIALIZED (SELECT s, v, CAST(1 AS DOUBLE) AS l FROM t WHERE d = {levels})"]
    for k in range(levels - 1, 0, -1):
        steps.append(f"x{k} AS MATERIALIZED (SELECT t.s, t.v, 1 + coalesce((SELECT sum(x.l / np.k) FROM e JOIN x{k + 1} x ON x.v = e.y AND x.s = t.s JOIN np ON np.s = x.s AND np.v = x.v WHERE e.x = t.v), 0) AS l FROM t WHERE t.d = {k})")
    return ", " + ", ".join(steps) + ", x AS (" + " UNION ALL ".join(f"SELECT * FROM x{k}" for k in range(1, levels + 1)) + ")"


@query("load_centrality", f"--views{_STRONG}{_distances(6)}{_loads(6)}, n AS (SELECT count(DISTINCT x) AS n FROM e) SELECT v AS item, round(sum(l - 1) / greatest((n - 1) * (n - 2), 1), 6) AS load FROM x CROSS JOIN n GROUP BY v, n")
def load(v: Views) -> DataFrame:
    return graph.load(_strong_authors(v))


@query("closeness_harmonic", f"""--views{_STRONG}{_distances(6)}, n AS (SELECT count(DISTINCT x) AS n FROM e)
SELECT s AS item, round(count(*) * 1.0 / sum(d) * count(*) / (n - 1), 6) AS closeness, round(sum(1.0 / d), 6) AS harmonic FROM t CROSS JOIN n GROUP BY s, n""")
def closeness(v: Views) -> DataFrame:
    return graph.closeness(_strong_authors(v))


#: Constraint of each node of (x, y, w), not rounded.
_CONSTRAINT = ", p AS (SELECT x AS i, y AS j, w * 1.0 / sum(w) OVER (PARTITION BY x) AS p FROM e), u AS (SELECT a.i, b.j, sum(a.p * b.p) AS s FROM p a JOIN p b ON b.i = a.j WHERE a.i <> b.j GROUP BY ALL), k AS (SELECT p.i AS item, sum((p.p + coalesce(u.s, 0)) * (p.p + coalesce(u.s, 0))) AS k FROM p LEFT JOIN u ON u.i = p.i AND u.j = p.j GROUP BY p.i)"


@query("brokerage", f"""--views{_AUTHORS}{_BOTH}{_distances(3)}{_BETWEEN}{_CONSTRAINT}, n AS (SELECT author AS item, count(*) AS n_docs FROM d GROUP BY author), m AS (SELECT count(DISTINCT x) AS m FROM e),
r AS (SELECT n.item, n.n_docs, coalesce(b.b / greatest((m - 1) * (m - 2), 1), 0) AS b, coalesce((SELECT sum(w) FROM e WHERE e.x = n.item), 0) AS s, coalesce(k.k, (SELECT max(k) FROM k), 0) AS k FROM n CROSS JOIN m LEFT JOIN b USING (item) LEFT JOIN k USING (item)),
z AS (SELECT item, """ + ", ".join(f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) * 1.0 / (max({c}) OVER () - min({c}) OVER ()) ELSE 0.5 END AS z_{c}" for c in ("b", "s", "k", "n_docs")) + " FROM r) SELECT item, round(0.45 * z_b + 0.25 * z_s + 0.20 * (1 - z_k) + 0.10 * z_n_docs, 6) AS score FROM z")
def brokerage(v: Views) -> DataFrame:
    mentions = v.authors.select("doc_id", F.col("author").alias("item"))
    pairs, names = cooccur.numbered_edges(mentions)
    docs = entity.presence(mentions).groupBy("item").agg(F.count("*").alias("n_docs"))
    found = graph.betweenness(pairs, digits=None).join(graph.degree(pairs).select("item", "strength"), "item").join(graph.constraint_of_dense(pairs), "item", "left").withColumnRenamed("item", "number")
    # every author has a row: one without partners has no paths and no strength, and its constraint counts as the greatest
    parts = docs.join(names.join(found, "number").drop("number"), "item", "left")
    return composite.brokerage(checkpointed(parts.fillna(0, ["betweenness", "strength"])))


@query("collaboration_network", f"""--views{_AUTHORS}{_BOTH}{_distances(3)}{_BETWEEN}, c AS (SELECT doc_id, count(*) AS k FROM d GROUP BY doc_id), x AS (SELECT d.author, c.k, p.citation FROM d JOIN c USING (doc_id) JOIN b_papers p USING (doc_id)),
i AS (SELECT author AS item, count(*) AS n_docs, count(*) FILTER (WHERE k = 1) AS n_solo, count(*) FILTER (WHERE k > 1) AS n_collab, avg(citation) FILTER (WHERE k = 1) AS s, avg(citation) FILTER (WHERE k > 1) AS c FROM x GROUP BY author), m AS (SELECT count(DISTINCT x) AS m FROM e)
SELECT item, n_docs, n_solo, n_collab, round(n_collab * 1.0 / n_docs, 6) AS rate, round(s, 6) AS mean_solo, round(c, 6) AS mean_collab, round(CASE WHEN s > 0 THEN c / s END, 6) AS ratio, (SELECT count(*) FROM e WHERE e.x = item) AS degree, (SELECT coalesce(sum(w), 0) FROM e WHERE e.x = item) AS strength,
round(coalesce(b.b, 0) / greatest((m - 1) * (m - 2), 1), 6) AS betweenness FROM i CROSS JOIN m LEFT JOIN b USING (item)""")
def collaboration_network(v: Views) -> DataFrame:
    return composite.collaboration_network(v.authors.select("doc_id", F.col("author").alias("item")), v.papers)


def _labels(rounds: int) -> str:
    steps = [f"{SQL}{_COUNTRIES}, r0 AS MATERIALIZED (SELECT DISTINCT x AS item, x AS c FROM e)"]
    for k in range(rounds):
        votes = f"SELECT e.y AS item, r.c, sum(e.w) AS v FROM e JOIN r{k} r ON r.item = e.x GROUP BY e.y, r.c"
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT item, c FROM (SELECT item, c, row_number() OVER (PARTITION BY item ORDER BY v DESC, c) AS n FROM ({votes})) WHERE n = 1)")
    return ", ".join(steps) + f" SELECT item, c AS community FROM r{rounds}"


@query("label_communities", _labels(5))
def communities(v: Views) -> DataFrame:
    return graph.label_communities(_country_edges(v), rounds=5)


def _hubs(rounds: int) -> str:
    """Rounds of hubs and authorities: the hub step takes the authorities before they are scaled."""
    steps = [f"{SQL}, l AS MATERIALIZED (SELECT DISTINCT src, dst FROM b_cites), o AS MATERIALIZED (SELECT src, count(*) AS o FROM l GROUP BY src), i AS MATERIALIZED (SELECT dst, count(*) AS i FROM l GROUP BY dst), x AS MATERIALIZED (SELECT src AS item FROM l UNION SELECT dst FROM l), h0 AS MATERIALIZED (SELECT item, 1.0 / count(*) OVER () AS h, CAST(0 AS DOUBLE) AS a FROM x)"]
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED (SELECT l.dst AS item, sum(h.h / o.o) AS a FROM l JOIN o USING (src) JOIN h{k} h ON h.item = l.src GROUP BY l.dst), b{k} AS MATERIALIZED (SELECT l.src AS item, sum(a.a / i.i) AS h FROM l JOIN i USING (dst) JOIN a{k} a ON a.item = l.dst GROUP BY l.src), h{k + 1} AS MATERIALIZED (SELECT x.item, coalesce(b.h, 0) / sum(b.h) OVER () AS h, coalesce(a.a, 0) / sum(a.a) OVER () AS a FROM x LEFT JOIN b{k} b USING (item) LEFT JOIN a{k} a USING (item))")
    return ", ".join(steps) + f" SELECT item, round(h * 1000, 6) AS hub, round(a * 1000, 6) AS authority FROM h{rounds}"


@query("salsa_rounds", _hubs(10))
def salsa_rounds(v: Views) -> DataFrame:
    """Ten rounds, whatever the change."""
    return graph.salsa(v.cites, rounds=10, tolerance=0.0).select("item", *(F.round(F.col(c) * 1000, 6).alias(c) for c in ("hub", "authority")))


@query("modularity_communities")
def modularity(v: Views) -> DataFrame:
    return graph.greedy_modularity(_strong_authors(v))


@query("first_split")
def first_split(v: Views) -> DataFrame:
    edges = _country_edges(v)
    return graph.first_split(edges.crossJoin(F.broadcast(edges.agg(F.avg("w").alias("_m")))).where("w > _m"))  # one row


@query("bridge_scores", f"""--views, e AS MATERIALIZED (SELECT DISTINCT src AS x, dst AS y FROM b_cites){_distances(7)}{_BETWEEN}, n AS (SELECT count(*) AS n FROM b_papers)
SELECT p.doc_id AS item, round(0.7 * round(coalesce(b.b, 0) / greatest((n - 1) * (n - 2), 1), 6) + 0.3 * least(p.citation * 1.0 / greatest(1, p.citation + 50), 1), 4) AS score FROM b_papers p CROSS JOIN n LEFT JOIN b ON b.item = p.doc_id""")
def bridge_scores(v: Views) -> DataFrame:
    papers = v.papers.select(F.col("doc_id").alias("item"), "citation")
    central = graph.directed_betweenness(v.cites, papers.select("item")).withColumn("betweenness", F.round("betweenness", 6))
    return temporal.bridge_scores(central, papers)


@query("paper_indicators", f"""--views, e AS MATERIALIZED (SELECT DISTINCT src AS x, dst AS y FROM b_cites){_distances(7)}{_BETWEEN}, n AS (SELECT count(*) AS n FROM b_papers), a AS (SELECT doc_id, count(DISTINCT author) AS a FROM b_authorships GROUP BY doc_id), k AS (SELECT doc_id, count(DISTINCT kwa) AS k FROM b_keywords GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS r FROM b_references GROUP BY doc_id), i AS (SELECT x AS doc_id, count(*) AS i FROM e GROUP BY x), q AS (SELECT p.doc_id, p.citation, round(coalesce(b.b, 0) / greatest((n - 1) * (n - 2), 1), 6) AS b FROM b_papers p CROSS JOIN n LEFT JOIN b ON b.item = p.doc_id)
SELECT q.doc_id AS item, q.citation, q.b AS betweenness, coalesce(a.a, 0) AS n_authors, coalesce(k.k, 0) AS n_keywords, coalesce(r.r, 0) AS n_references, coalesce(i.i, 0) AS n_internal, round(0.7 * q.b + 0.3 * least(q.citation * 1.0 / greatest(1, q.citation + 50), 1), 4) AS score
FROM q LEFT JOIN a USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN i USING (doc_id)""")
def paper_indicators(v: Views) -> DataFrame:
    cites = checkpointed(v.cites)
    central = graph.directed_betweenness(cites, v.papers.select(F.col("doc_id").alias("item"))).withColumn("betweenness", F.round("betweenness", 6))
    return temporal.paper_indicators(v.papers, central, v.authors, v.keywords.select("doc_id", F.col("kwa").alias("keyword")), v.references, cites)


#: Knowledge flows u -> v, and the number of paths from sources (or any node) to each node and from each node to sinks.
_FLOWS = ", f AS MATERIALIZED (SELECT DISTINCT dst AS u, src AS v FROM b_cites)"


def _paths(name: str, start: str, a: str, b: str) -> str:
    return f", {name} AS MATERIALIZED (WITH RECURSIVE r(x) AS ({start} UNION ALL SELECT f.{b} FROM r JOIN f ON f.{a} = r.x) SELECT x, count(*) AS c FROM r GROUP BY x)"


_FROM_SOURCES = _paths("dn", "SELECT DISTINCT u FROM f WHERE u NOT IN (SELECT v FROM f)", "u", "v")
_FROM_ANY = _paths("dn", "(SELECT u FROM f UNION SELECT v FROM f)", "u", "v")
_TO_SINKS = _paths("up", "SELECT DISTINCT v FROM f WHERE v NOT IN (SELECT u FROM f)", "v", "u")
_SUMMED = " SELECT f.u, sum(CAST(dn.c AS DOUBLE) * up.c) AS weight, count(*) AS n FROM f JOIN dn ON dn.x = f.u JOIN up ON up.x = f.v GROUP BY f.u"


def _weights(v: Views, kind: str) -> DataFrame:
    return graph.path_weights(v.cites, kind).groupBy("u").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


@query("path_weights_spc", f"--views{_FLOWS}{_FROM_SOURCES}{_TO_SINKS}{_SUMMED}")
def path_weights_spc(v: Views) -> DataFrame:
    return _weights(v, "spc")


@query("path_weights_splc", f"--views{_FLOWS}{_FROM_ANY}{_TO_SINKS}{_SUMMED}")
def path_weights_splc(v: Views) -> DataFrame:
    return _weights(v, "splc")


@query("path_weights_spnp", f"--views{_FLOWS}, r AS MATERIALIZED (WITH RECURSIVE r(x, y) AS (SELECT u, v FROM f UNION SELECT r.x, f.v FROM r JOIN f ON f.u = r.y) SELECT * FROM r), dn AS (SELECT y AS x, count(*) + 1 AS c FROM r GROUP BY y UNION ALL SELECT u, 1 FROM (SELECT DISTINCT u FROM f) WHERE u NOT IN (SELECT y FROM r)), up AS (SELECT x, count(*) + 1 AS c FROM r GROUP BY x UNION ALL SELECT v, 1 FROM (SELECT DISTINCT v FROM f) WHERE v NOT IN (SELECT x FROM r)){_SUMMED}")
def path_weights_spnp(v: Views) -> DataFrame:
    return _weights(v, "spnp")


@query("main_path_spc", f"""--views{_FLOWS}{_FROM_SOURCES}{_TO_SINKS}, w AS MATERIALIZED (SELECT f.u, f.v, CAST(dn.c AS DOUBLE) * up.c AS w FROM f JOIN dn ON dn.x = f.u JOIN up ON up.x = f.v),
p AS (WITH RECURSIVE p(x, s, l) AS (SELECT DISTINCT u, CAST(0 AS DOUBLE), [u] FROM w WHERE u NOT IN (SELECT v FROM w) UNION ALL SELECT w.v, p.s + w.w, list_append(p.l, w.v) FROM p JOIN w ON w.u = p.x) SELECT l FROM p ORDER BY s DESC, x, list_reverse(l) LIMIT 1),
q AS (SELECT l, unnest(range(1, len(l))) AS i FROM p) SELECT CAST(i - 1 AS INT) AS step, l[i] AS u, l[i + 1] AS v FROM q""")
def main_path(v: Views) -> DataFrame:
    return graph.main_path(graph.path_weights(v.cites, "spc"))


@query("history_ends", "--views, n AS (SELECT 'cited' AS kind, dst AS doc_id, count(*) AS n FROM b_cites GROUP BY dst UNION ALL SELECT 'citing', src, count(*) FROM b_cites GROUP BY src) SELECT kind, doc_id, n FROM n WHERE n = (SELECT max(n) FROM n m WHERE m.kind = n.kind)")
def history_ends(v: Views) -> DataFrame:
    return citation.history_ends(v.cites)


@query("history_paths", """--views, e AS MATERIALIZED (SELECT DISTINCT src, dst FROM b_cites), r AS (WITH RECURSIVE r(s, t, p) AS (SELECT src, dst, [src, dst] FROM e UNION ALL SELECT r.s, e.dst, list_append(r.p, e.dst) FROM r JOIN e ON e.src = r.t) SELECT * FROM r),
k AS MATERIALIZED (SELECT s, t, p FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY len(p), p) AS n FROM r) WHERE n = 1 AND len(p) >= 3),
x AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM k), y AS (SELECT p, p[i] AS s, unnest(p[i + 1:]) AS t FROM x WHERE i < len(p)),
w AS (SELECT DISTINCT k.s, k.t FROM k JOIN y ON y.s = k.s AND y.t = k.t WHERE (len(y.p) > len(k.p) OR (len(y.p) = len(k.p) AND y.p < k.p)) AND list_has_all(y.p, k.p))
SELECT k.s AS source, k.t AS target, CAST(len(k.p) AS INT) AS n, array_to_string(k.p, '|') AS path FROM k ANTI JOIN w ON w.s = k.s AND w.t = k.t""")
def history_paths(v: Views) -> DataFrame:
    return citation.history_paths(v.cites, least=3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)
