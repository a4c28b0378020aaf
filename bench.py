"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

import importlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "top_authors_by_h", "author_metrics", "entity_presence", "per_year", "bradford_zones", "team_sizes", "productivity_author", "heatmap_y_per_x", "sankey_flows", "coauthor_edges", "country_edges",
    "bibliographic_coupling", "co_cited_pairs", "local_citation_edges", "reference_diversity", "disruption_index", "sleeping_beauties", "term_growth", "bursts", "concept_flows", "specialization_index",
    "collaboration_impact", "ngrams_top", "tf_idf", "nearest_vectors", "first_of_duplicates", "degree_centrality", "components", "pagerank", "citation_depth",
    "p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_ids", "p8_containers", "p9_found",
)


def main() -> None:
    from pyspark.sql import SparkSession

    entry = importlib.import_module("__spark_entry__")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = entry.queries()
    known["entity_mentions"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the engine
    took = {}
    for name in HEADLINE:
        if name in known:
            began = time.time()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
