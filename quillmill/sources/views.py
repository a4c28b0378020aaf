"""The analytic tables as a bibliographic corpus: papers, authorships, keywords, references, citations.

Papers are orders, authors are suppliers of their lines, keywords are brands and types of parts, references are
part keys, and a paper cites an earlier paper whose key one of its references names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The same views as SQL common table expressions.
SQL = """
WITH b_papers AS (SELECT o_orderkey AS doc_id, CAST(year(o_orderdate) AS INT) AS year, CAST(floor(o_totalprice / 10000) AS INT) AS citation,
  o_orderstatus AS document_type, o_orderpriority AS language, concat('j_', CAST(o_custkey AS VARCHAR)) AS journal FROM orders),
b_authorships AS (SELECT l.l_orderkey AS doc_id, row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) - 1 AS pos,
  s.s_name AS author, n.n_name AS country, r.r_name AS region FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey
  JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey),
b_keywords AS (SELECT l.l_orderkey AS doc_id, lower(p.p_brand) AS kwa, lower(p.p_type) AS kwp, lower(p.p_name) AS term FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey),
b_references AS (SELECT l_orderkey AS doc_id, concat('r_', CAST(l_partkey AS VARCHAR)) AS ref, l_partkey AS ref_doc FROM lineitem),
b_cites AS (SELECT DISTINCT a.doc_id AS src, b.doc_id AS dst, a.year AS src_year, b.year AS dst_year
  FROM lineitem l JOIN b_papers a ON a.doc_id = l.l_orderkey JOIN b_papers b ON b.doc_id = l.l_partkey WHERE a.year > b.year)
"""


class Views:
    """The views over the parquet tables of a folder; every view reads only the columns it needs."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def papers(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year"), F.floor(F.col("o_totalprice") / 10000).cast("int").alias("citation"),
            F.col("o_orderstatus").alias("document_type"), F.col("o_orderpriority").alias("language"), F.concat(F.lit("j_"), F.col("o_custkey").cast("string")).alias("journal"),
        )

    @property
    def _authors(self) -> DataFrame:
        return (
            self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("author"), F.col("n_name").alias("country"), F.col("r_name").alias("region"))
        )

    @property
    def authors(self) -> DataFrame:
        """(doc_id, author, country, region) without positions: no window, so no sort."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_suppkey").join(self._authors, "l_suppkey").drop("l_suppkey")

    @property
    def authorships(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").withColumn("pos", F.row_number().over(order) - 1)
        return lines.select(F.col("l_orderkey").alias("doc_id"), "pos", "l_suppkey").join(self._authors, "l_suppkey").drop("l_suppkey")

    @property
    def keywords(self) -> DataFrame:
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_brand").alias("kwa"), F.lower("p_type").alias("kwp"), F.lower("p_name").alias("term"))
        return self.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_partkey").join(part, "l_partkey").drop("l_partkey")

    @property
    def references(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("r_"), F.col("l_partkey").cast("string")).alias("ref"), F.col("l_partkey").alias("ref_doc"))

    @property
    def cites(self) -> DataFrame:
        years = self.papers.select("doc_id", "year")
        pairs = self.table("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
        src, dst = years.toDF("src", "src_year"), years.toDF("dst", "dst_year")
        return pairs.join(dst, "dst").join(src, "src").where("src_year > dst_year").select("src", "dst", "src_year", "dst_year")
