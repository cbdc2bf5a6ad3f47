"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line of seconds (median of three, after a warm-up)."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from memloom.plans import registry

HEADLINE = (
    "edges_cooccurrence", "edge_evidence", "edge_evidence_pack", "what_connects", "timeline", "graph_feed_d2", "resolve_entity", "assemble_entities",
    "mention_worksheet", "source_stats", "browse_conversations", "newest_wins_upsert", "active_path", "chunk_messages", "content_hashes", "hash_dedup",
    "redact_secrets", "message_parts", "bm25_topk", "knn_topk", "hybrid_rrf", "split_assignment",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(4):
            begin = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
