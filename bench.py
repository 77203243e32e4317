"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
cores.  Every query is evaluated in full (no-op sink), twice; the second time counts, so
that JVM warm-up does not.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quasirisk import build_session  # noqa: E402
from workload import registered  # noqa: E402

HEADLINE = [
    "risk_summary",
    "risk_summary_lineitem",
    "unique_rows",
    "column_influence_lineitem",
    "combination_contribution_lineitem",
    "pif_lineitem",
    "cell_information_gain_orders",
    "gain_summary",
    "suda_scores",
    "suda_contributions_lineitem",
    "suda_record_table",
    "encode_categories",
    "mad_outliers",
    "boxplot_statistics",
    "combine_values",
    "round_up",
    "profile",
    "load_csv_schema",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        spark__master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
        # Python call sites attached to every expression: for debugging only.
        spark__python__sql__dataFrameDebugging__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = registered()

    def run(name: str) -> float:
        start = time.perf_counter()
        known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in HEADLINE:
        run(name)
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    scale = re.search(r"sf([0-9.]+)/?$", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
