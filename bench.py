"""Seconds of the headline queries, as one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from factloom.plans import answer_queries, catalogue, grounding_queries, memory_queries, state_queries  # noqa: F401  (they register their queries)

HEADLINE = ["slot_versions", "state_as_of", "late_data_uncertain", "interval_conflicts", "link_pool_top8", "cascade_strict", "protected_replacement", "relational_path_2hop", "retrieval_score_topk", "semantic_dedup", "chunk_windows", "token_f1", "session_window", "pricing_summary", "cube_orders", "cascade_propagate", "goal_path_3hop", "dependency_candidates", "selector_hits", "active_slot_overlaps", "consolidated_candidates", "canonical_facts", "quote_spans", "uncovered_ranges", "fact_chunks", "boundary_chunks", "rolling_tokens", "premise_verdicts", "answer_contexts", "stated_dependencies"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["pricing_summary"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
