"""Shapes of physical plans: what must not be in them, and what must be saved by the way tables are stored."""

import re

import pytest

from sward import operators as op
from sward.plans import shared
from sward.plans.registry import queries
from sward.sources import roles

QUERIES = queries()

def plan_of(df) -> str:
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def parents(plan: str):
    """(line, text of the operator above it) for every line of a plan tree."""
    above: list[tuple[int, str]] = []
    for line in plan.splitlines():
        m = re.match(r"^([\s:|+\-]*)(.*)$", line)
        depth, text = len(m.group(1)), m.group(2)
        while above and above[-1][0] >= depth:
            above.pop()
        yield text, (above[-1][1] if above else "")
        above.append((depth, text))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_product_no_global_window(name, spark, sf_dir):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert not re.search(r"EvalPython|InPandas|InArrow", plan)
    for text, parent in parents(plan):
        if text.startswith("Exchange SinglePartition"):
            assert not re.match(r"(\*\(\d+\) )?(Sort|Window)", parent), "a window without groups gathers all rows"


def test_scan_is_narrow_and_filtered(spark, sf_dir):
    plan = plan_of(QUERIES["dominance_index"](spark, sf_dir))
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "l_partkey" in line)
    assert "l_extendedprice" not in scan and "l_comment" not in scan
    assert "PushedFilters" in scan and "Not(EqualTo(l_returnflag,R))" in scan


@pytest.mark.parametrize(
    "name",
    [
        "baseline_abundance",
        "cover_by_class",
        "richness_by_class_provenance",
        "first_differences",
        "lagged_loss_set",
        "lost_at_end_set",
        "turnover_first_year",
        "turnover_previous_year",
        "class_profile",
        "lifespan_richness",
        "richness_by_class",
        "species_cover_change",
        "baseline_total_cover",
    ],
)
def test_tables_stored_by_plot_need_no_shuffle(name, spark, sf_dir):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "Exchange hashpartitioning" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["years_absent", "final_year_abundance", "dominant_loss_events", "di_over_time"])
def test_plot_joins_are_co_located_without_broadcast(name, spark, sf_dir):
    """With broadcasts off (tables too large for them) only joins on site-level keys may move rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES[name](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"Exchange hashpartitioning\(site_code, plot", plan)


@pytest.mark.parametrize("name", ["site_min_years", "studies_with_both_measures", "standard_years", "years_since_start"])
def test_rows_of_a_group_are_not_gathered(name, spark, sf_dir):
    """With broadcasts off but for the few heavy groups, no shuffle goes by study or site alone."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES[name](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"Exchange hashpartitioning\((STUDY_ID|site_code), \d", plan)


def test_no_row_copies_for_many_conditions(spark, sf_dir):
    assert "Expand" not in plan_of(QUERIES["richness_class_systems"](spark, sf_dir))


def test_completed_panel_is_not_shuffled_again(spark, sf_dir):
    panel = shared.panel(spark, sf_dir)
    runs = op.absence_runs(panel, ["site_code", "plot", "Taxon"], "year_trt", longest=True)
    assert "Exchange hashpartitioning" not in plan_of(runs)


def test_completed_panel_places_rows_once(spark, sf_dir):
    """Rows that are not stored by plot are placed once; the windows after it add nothing."""
    rows = shared.enriched(spark, sf_dir).repartition(5)
    panel = op.complete_panel(
        rows, ["site_code"], ["plot", "year_trt", "trt"], "Taxon", "rel_cover", cluster_by=["site_code", "plot"]
    )
    runs = op.absence_runs(panel, ["site_code", "plot", "Taxon"], "year_trt", longest=True)
    assert plan_of(runs).count("Exchange hashpartitioning") == plan_of(panel).count("Exchange hashpartitioning") == 1


def test_records_are_grouped_before_the_plot_join(spark, sf_dir):
    plan = plan_of(roles.cover(spark, sf_dir))
    assert plan.index("Join [l_suppkey]") < plan.index("partial_sum(l_quantity)")


def test_flagship_reads_records_once(spark, sf_dir):
    df = QUERIES["dominance_index"](spark, sf_dir)
    df.collect()
    final = plan_of(df).split("Initial Plan")[0]
    assert sum("FileScan" in line and "l_partkey" in line for line in final.splitlines()) == 1
    assert "ReusedExchange" in final


def test_role_facts(spark, sf_dir):
    """Known counts of the role binding at sf0.01."""
    if not sf_dir.endswith("sf0.01"):
        pytest.skip("counts are those of sf0.01")
    rows = shared.enriched(spark, sf_dir)
    assert rows.count() == 7072
    classes = {r.di_class: r["count"] for r in rows.groupBy("di_class").count().collect()}
    assert classes == {"Dominant": 77, "Subordinate": 5734, "Rare": 22, None: 1239}
    panel = shared.panel(spark, sf_dir)
    assert panel.count() == 9100 and panel.where("pa = 0").count() == 2028


def test_invariants(spark, sf_dir):
    rows = shared.enriched(spark, sf_dir)
    sums = rows.groupBy("site_code", "plot", "year").agg({"rel_cover": "sum"}).toDF("s", "p", "y", "x")
    assert sums.where("abs(x - 1) > 1e-9").count() == 0
    assert rows.where("rel_freq < 0 or rel_freq > 1").count() == 0
    r = QUERIES["richness_by_class"](spark, sf_dir)
    total = rows.groupBy("site_code", "plot", "year").agg({"Taxon": "count"}).toDF("site_code", "plot", "year", "n")
    assert r.join(total, ["site_code", "plot", "year"]).where(
        "sr_domspp + sr_rarespp + sr_subordspp > n"
    ).count() == 0
    kept = QUERIES["kept_ratio"](spark, sf_dir).first()
    assert 0 < kept.row_ratio <= 1 and 0 < kept.study_ratio <= 1
    assert QUERIES["coverage_consistency"](spark, sf_dir).first().n_mismatch == 0
