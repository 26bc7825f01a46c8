"""Time the headline queries; print one JSON line.

BENCH_SF_DIR picks the data (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sightline.plans import QUERIES  # noqa: E402
from sightline.session import local_session  # noqa: E402

HEADLINE = [
    "job_state", "state_merged", "new_per_run", "run_audit", "active_per_company",
    "location_match_scale", "location_match_multi", "title_pick", "unescape",
    "recent_window_7d", "listings_by_company", "search_listings", "digest_rows", "digest_fragments",
    "decisions_aligned", "chunk_failover", "state_with_decisions", "criteria_score",
    "src_greenhouse", "src_workday", "src_html_links", "src_atom", "src_html_table",
    "json_discover", "dom_discover", "merge_by_key", "first_occurrence", "paged_source",
    "chunk_stats", "decision_stats", "state_streamed", "src_phenom", "slug_title", "capture_failures",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench")
    QUERIES["new_per_run"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total time of the headline queries",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
