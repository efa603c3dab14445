"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` is the folder of the tables, ``BENCH_CPUS`` the number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from scorebook.plans.catalogue import QUERIES  # noqa: E402
from scorebook.session import spark_session  # noqa: E402

HEADLINE = (
    "d1_rate_by_level",
    "d5_median_by_outcome",
    "d8_score_histogram",
    "d11_all_breakdowns",
    "e3_association_ranking",
    "e6_confusion_and_rates",
    "e7_e8_ranking_metrics",
    "e9_reliability_table",
    "e11_segment_performance",
    "f2_threshold_sweep",
    "f3_h1_sweep_basis",
    "f7_sensitivity",
    "h5_stratified_split",
    "b1_b2_clean",
    "b6_b8_number_and_consistency_checks",
    "c5_held_out_match",
    "d17_selection_summary",
    "i2_page_past_the_end",
    "g4_one_way_complementary",
    "g6_joint_guard",
    "g14_segment_guard",
    "g19_cut_difference_audit",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = spark_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus != "*" else "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    names = [n for n in HEADLINE if not only or n in only]
    # One warm-up run, so the first query is not charged for starting the JVM.
    QUERIES[names[0]](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
