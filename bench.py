"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "cleaning_waterfall", "clean_corpus", "keyword_scores", "hybrid_screen", "corpus_sensitivity",
    "best_threshold", "roc_auc", "stratified_split_labels", "anchor_scores", "discipline_assign",
    "threshold_grid_default", "breadth_sweep", "discipline_share", "academic_clean", "term_counts",
    "term_counts_ngrams", "ctfidf", "topic_words", "representative_docs", "topic_overlap",
    "topic_similarity", "topic_diversity", "dictionary_filter", "coherence_npmi", "coherence_cv",
    "embed_documents", "anchor_text_scores", "cluster_topics",
    "evaluation_table", "merge_topics", "yearly_corpus", "merged_topic_info", "topic_info_views", "cluster_grid",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from catalog.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["cleaning_waterfall"](spark, sf_dir).count()  # starts the JVM's compiler, not counted
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
