"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pricebook.plans import registry
from pricebook.plans.fixtures import STORED, Tables
from pricebook.session import build_session

HEADLINE = (
    "b09_elements_with_hierarchy", "b11_sections_with_element_count", "b13_section_path", "b15_elements_flat",
    "c07_search_elements", "c08_suggest", "c09_similar_elements", "c10_match_text", "c13_search_similar",
    "c15_fuzzy_match_document", "c17_price_history", "d01_statistics", "d05_group_by_section", "d08_price_bands",
    "d09_extract_keywords", "d10_quality_issues", "d13_quality_classes", "e07_parse_number_standard", "f05_classify_files",
    "f09_best_sheet", "f11_structure_score", "g01_find_header_row", "g09_map_columns_by_content", "g18_client_from_content",
    "g21_detect_sections", "g25_score_elements", "g31_attach_sections", "h03_resolve_lots", "h04_resolve_sections",
    "i04_correct_sections_elements", "j02_evaluate_sections", "k01_import_log_stats", "k09_run_log_events",
    "k10_run_log_counts", "k20_pack_batches", "l02_error_alerts", "l05_metric_summary",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    only = sys.argv[1:] or HEADLINE
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = registry.queries(), {}
    t0 = time.time()
    t = Tables(spark, sf_dir)
    for name in STORED:             # the stored entity tables and grids, counted as their own step
        getattr(t, name)
    times["load_stored_views"] = round(time.time() - t0, 3)
    for name in only:
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
