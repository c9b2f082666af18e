"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sward.plans import shared  # noqa: E402
from sward.plans.registry import queries  # noqa: E402
from sward.session import local_session  # noqa: E402

HEADLINE = (
    "relative_cover",
    "dominance_index",
    "complete_panel",
    "richness_by_class_provenance",
    "cover_by_class",
    "lifespan_richness",
    "first_differences",
    "max_absence_run",
    "prop_lost_by_year",
    "absence_vs_control",
    "pct_diff_from_control",
    "lagged_loss_set",
    "turnover_first_year",
    "dominant_loss_events",
    "sample_coverage",
    "coverage_filtered",
    "species_panel_metrics",
    "loss_summary",
    "abundance_biomass_ranks",
    "six_number_summary",
    "ols_by_study",
    "logit_by_site",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, app="sward-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executors before the clock
    times: dict[str, float] = {}

    def clock(name, run):
        t = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - t, 3)

    # the prepared tables are part of the work: they are timed on their own, the queries then read them
    clock("prepare_cover", lambda: shared.enriched(spark, sf_dir))
    clock("prepare_series", lambda: shared.long_series(spark, sf_dir))
    clock("prepare_metrics", lambda: shared.metrics(spark, sf_dir))
    all_queries = queries()
    for name in HEADLINE:
        clock(name, lambda: all_queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    shared.release(spark)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(sf_dir)).replace("sf", ""),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
