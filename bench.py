"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import re
import sys
import time

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", f"--driver-memory {os.environ.get('BENCH_MEMORY', '16g')} pyspark-shell")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_performance_by_security", "performance_status_histogram", "trade_performance", "fixed_horizon_excess", "security_performance",
    "asof_next_bar", "asof_previous_bar", "normalize_disclosures_feed", "dedupe_occurrences", "merge_variants", "overview_totals",
    "overview_monthly", "top_politicians", "entity_resolution", "group_sizes", "newest_per_security", "size_percentile_prior", "delay_signal",
    "industry_relevance", "mapping_review_stats", "seat_intervals", "effective_seats", "committee_signal", "context_flags", "screen_counts",
    "price_batch_outcome", "committee_events_found", "stream_ingest",
]
ALIASES = {"entity_resolution": "match_politicians"}


def main():
    from civicledger.plans.queries import QUERIES
    from civicledger.session import build_session

    spark = build_session("bench", f"local[{CPUS}]", CPUS)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name):
        start = time.time()
        QUERIES[ALIASES.get(name, name)](spark, FOLDER).write.format("noop").mode("overwrite").save()
        return time.time() - start

    for name in ("overview_totals", "flagship_performance_by_security"):
        run(name)  # warm the session, not the data of the query that follows
    times = {name: round(run(name), 3) for name in HEADLINE}
    found = re.search(r"sf([\d.]+)", FOLDER)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(found.group(1)) if found else FOLDER}))


if __name__ == "__main__":
    main()
