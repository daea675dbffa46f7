"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every query is run once
to warm up and then timed; a run reads all result rows inside Spark without bringing them to Python.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from linkloom.catalog import QUERIES  # noqa: E402
from linkloom.session import local_session  # noqa: E402

HEADLINE = [
    "p1_classify_targets",
    "p2_standardize_targets",
    "p7_redact_documents",
    "e1_text_entities",
    "e4_dns_entities",
    "e5_whois_entities",
    "e18_all_adapters_entities",
    "r1_resolved_entities",
    "r3_co_occurring_users",
    "r4_similar_names",
    "r7_linked_accounts",
    "l9_structural_links",
    "c1_scored_entities",
    "c3_scored_graph",
    "a4_values_shared_between_sources",
    "a4_parts_shared_by_suppliers",
    "a10_report_lines",
    "j6_announced_prefixes",
    "w2_interleaved_hits",
    "v5_selected_candidates",
    "g2_neighbours",
    "g4_paths",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), shuffle_partitions=8, app="bench")
    times: dict[str, float] = {}
    wanted = sys.argv[1:] or HEADLINE

    def run(name: str) -> None:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    for name in wanted:
        run(name)
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "headline queries, total wall time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
