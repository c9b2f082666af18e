"""Hand-made fixtures: input and expected output of each operator."""

import math
import random

import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from sward import operators as op
from sward.sources import files, schemas

P = "site_code string, plot int, year_trt int, Taxon string, x double"


def panel_rows():
    return [
        ("A", 1, 0, "a", 1.0),
        ("A", 1, 0, "b", 2.0),
        ("A", 1, 1, "a", 3.0),
        ("A", 2, 0, "c", 4.0),
    ]


# --- completion, baselines, differences ---


def test_complete_panel(rows):
    out = op.complete_panel(rows(P, panel_rows()), ["site_code"], ["plot", "year_trt"], "Taxon", "x")
    got = as_dict(out, ["plot", "year_trt", "Taxon"], "x")
    assert len(got) == 9 and sum(v == 0 for v in got.values()) == 5
    assert got[(1, 0, "b")] == 2.0 and got[(2, 0, "a")] == 0.0
    assert out.where("pa = 1").count() == 4


def test_complete_panel_sums_duplicates_and_clusters(rows):
    data = [*panel_rows(), ("A", 1, 0, "a", 10.0)]
    out = op.complete_panel(
        rows(P, data), ["site_code"], ["plot", "year_trt"], "Taxon", "x", cluster_by=["site_code", "plot"], block=1
    )
    got = as_dict(out, ["plot", "year_trt", "Taxon"], "x")
    assert len(got) == 9 and got[(1, 0, "a")] == 11.0


@pytest.mark.parametrize("block", [1, 2, 64])
def test_complete_panel_keeps_null_species_and_keys(rows, block):
    rng = random.Random(block)
    data = [
        (rng.choice(["A", "B", None]), rng.choice([1, 2, None]), rng.randrange(3), rng.choice([None, *"abcdefgh"]), rng.choice([1.0, 2.5, None]))
        for _ in range(90)
    ]
    want = {}
    for g, p, y, *_ in data:
        for other, _, _, t, _ in data:
            if other == g:
                x = [r[4] for r in data if r[:4] == (g, p, y, t) and r[4] is not None]
                want[(g, p, y, t)] = sum(x) if x else 0.0
    out = op.complete_panel(rows(P, data), ["site_code"], ["plot", "year_trt"], "Taxon", "x", block=block)
    assert as_dict(out, ["site_code", "plot", "year_trt", "Taxon"], "x") == want
    assert op.complete_panel(rows(P, []), ["site_code"], ["plot", "year_trt"], "Taxon", "x", block=block).count() == 0


def test_baseline(rows):
    df = rows(P, [("A", 1, 0, "a", 0.5), ("A", 1, 1, "a", 0.3), ("A", 1, 1, "b", 0.7)])
    out = op.baseline(df, ["site_code", "plot", "Taxon"], "year_trt", "x")
    out = op.baseline(out, ["site_code", "plot", "Taxon"], "year_trt", "x", default=0.0, name="z")
    assert as_dict(out, ["Taxon", "year_trt"], "x_t0") == {("a", 0): 0.5, ("a", 1): 0.5, ("b", 1): None}
    assert as_dict(out, ["Taxon", "year_trt"], "z")[("b", 1)] == 0.0


def test_first_diff_at_plot_year_grain(rows):
    df = rows(
        "site_code string, plot int, year_trt int, Taxon string, sr int",
        [("A", 1, 0, "a", 3), ("A", 1, 0, "b", 3), ("A", 1, 1, "a", 5), ("A", 1, 1, "b", 5), ("A", 1, 2, "a", 4)],
    )
    out = op.first_diff(df, ["site_code", "plot"], "year_trt", ["sr"])
    assert as_dict(out, "year_trt", "d_sr") == {0: None, 1: 2, 2: -1}


def test_log_ratio(rows):
    df = rows("u int, t int, s int", [(1, 0, 3), (1, 1, 5)])
    got = as_dict(op.log_ratio_change(df, ["u"], "t", ["s"]), "t", "lr_s")
    assert got[0] is None and math.isclose(got[1], math.log(6) - math.log(4))


def test_losses(rows):
    df = rows("u int, t int, x double", [(1, 0, 2.0), (1, 1, 0.0), (1, 2, 0.0), (1, 3, 1.0)])
    all_ = as_dict(op.losses(df, ["u"], "t", "x", at_risk_only=False), "t", "lost")
    assert all_ == {0: None, 1: 1, 2: 0, 3: 0}
    assert as_dict(op.losses(df, ["u"], "t", "x"), "t", "lost") == {1: 1}


def test_absence_runs(rows):
    df = rows("u int, t int, pa int", [(1, i, v) for i, v in enumerate([1, 0, 0, 1, 0])])
    assert as_dict(op.absence_runs(df, ["u"], "t"), "t", "cons_abs") == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1}
    assert as_dict(op.absence_runs(df, ["u"], "t", longest=True), "u", "cons_abs_max") == {1: 2}


def test_absence_runs_leading(rows):
    df = rows("u int, t int, pa int", [(1, i, v) for i, v in enumerate([0, 0, 1])])
    assert as_dict(op.absence_runs(df, ["u"], "t"), "t", "cons_abs") == {0: 1, 1: 2, 2: 0}


def test_keep_groups(rows):
    df = rows("g string, y int, m string, v double", [("a", 1, "p", 1.0), ("a", 2, "q", 1.0), ("b", 1, "p", 0.0)])
    assert {r.g for r in op.keep_groups(df, ["g"], min_distinct={"y": 2}).collect()} == {"a"}
    assert {r.g for r in op.keep_groups(df, ["g"], nonzero="v").collect()} == {"a"}
    assert {r.g for r in op.keep_groups(df, ["g"], levels={"m": 1}).collect()} == {"b"}


def test_quarantine_keeps_undecided(rows):
    df = rows("s string, y int", [("bad", 0), ("bad", 1), ("bad", None), ("ok", 0)])
    out = op.drop_bad_records(df, (F.col("s") == "bad") & (F.col("y") == 0))
    assert out.count() == 3


def test_latest_keeps_ties(rows):
    df = rows("g int, t int, v string", [(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, 1, "d")])
    assert {r.v for r in op.latest(df, ["g"], "t").collect()} == {"b", "c", "d"}


def test_ratio_to_and_short_series(rows):
    df = rows("u int, t int, x double", [(1, 0, 0.0), (1, 1, 2.0), (1, 2, 4.0), (2, 0, 1.0), (2, 1, 3.0)])
    assert as_dict(op.ratio_to(df, ["u"], "t", "x", "max"), ["u", "t"], "ratio")[(1, 1)] == 0.5
    assert as_dict(op.ratio_to(df, ["u"], "t", "x", "first"), ["u", "t"], "ratio")[(1, 2)] == 2.0
    t0 = as_dict(op.ratio_to(df, ["u"], "t", "x", "t0"), ["u", "t"], "ratio")
    assert t0[(1, 1)] is None and t0[(2, 1)] == 3.0
    f3 = as_dict(op.ratio_to(df, ["u"], "t", "x", "first3"), ["u", "t"], "ratio")
    assert f3[(1, 2)] == 2.0 and f3[(2, 1)] is None
    with pytest.raises(ValueError):
        op.ratio_to(df, ["u"], "t", "x", "other")


def test_last_k_active(rows):
    df = rows("u int, t int, x double", [(1, t, float(t == 0)) for t in range(4)] + [(2, t, 1.0) for t in range(4)])
    out = op.last_k_active(df, ["u"], "t", "x").groupBy("u").agg(F.max("active_last_k").alias("a"))
    assert as_dict(out, "u", "a") == {1: False, 2: True}


def test_years_since_start(rows):
    df = rows("g int, y int", [(1, 2000), (1, 2003)])
    assert as_dict(op.years_since_start(df, ["g"], "y", base=1), "y", "std_year") == {2000: 1, 2003: 4}


def test_dup_audit(rows):
    df = rows("k string, y int, s string", [("a", 1, "p"), ("a", 1, "q"), ("a", 2, "p"), ("b", 1, "p")])
    out = op.dup_audit(df, ["k"], "y", "s")
    assert as_dict(out, "k", "n_years") == {"a": 2, "b": 1}
    assert as_dict(out, "k", "n_records") == {"a": 3, "b": 1}
    assert as_dict(out, "k", "n_subplots") == {"a": 2, "b": 1}


def test_relative_abundance_no_total(rows):
    df = rows("u int, sp string, x double, live int", [(1, "a", 0.0, 1), (2, "a", 3.0, 1), (2, "b", 1.0, 0)])
    out = op.relative_abundance(df, ["u"], "x")
    assert as_dict(out, ["u", "sp"], "rel") == {(1, "a"): 0.0, (2, "a"): 0.75, (2, "b"): 0.25}
    out = op.relative_abundance(df, ["u"], "x", live=F.col("live") == 1)
    assert as_dict(out, ["u", "sp"], "rel") == {(1, "a"): 0.0, (2, "a"): 1.0, (2, "b"): 0.0}


# --- order ---


def test_rescaled_rank_ties(rows):
    df = rows("u int, i int, x double", [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 2.0), (2, 0, 7.0), (2, 1, 7.0)])
    got = as_dict(op.rescaled_rank(df, ["u"], "x"), ["u", "i"], "rel_rank")
    assert got == {(1, 0): 0.0, (1, 1): 1.0, (1, 2): 1.0, (2, 0): 0.5, (2, 1): 0.5}


def test_rank_zero_readings(rows):
    df = rows("u int, i int, x double", [(1, 0, 0.0), (1, 1, 0.0), (1, 2, 5.0), (1, 3, 9.0)])

    def both(zero):
        out = op.rescaled_rank(df, ["u"], "x", zero)
        return as_dict(out, "i", "rank"), as_dict(out, "i", "rel_rank")

    assert both("rank") == ({0: 1, 1: 1, 2: 3, 3: 4}, {0: 0.0, 1: 0.0, 2: 2 / 3, 3: 1.0})
    assert both("null_min")[1] == {0: None, 1: None, 2: 0.0, 3: 1.0}
    assert both("skip") == ({0: None, 1: None, 2: 1, 3: 2}, {0: 0.0, 1: 0.0, 2: 0.0, 3: 1.0})
    assert both("shift") == ({0: 0, 1: 0, 2: 1, 3: 2}, {0: 0.0, 1: 0.0, 2: 0.5, 3: 1.0})
    with pytest.raises(ValueError):
        op.rescaled_rank(df, ["u"], "x", "other")


def test_quantile_groups(rows):
    df = rows("s int, sp string, x double", [(1, c, float(i)) for i, c in enumerate("abcde")] + [(1, "z", None)])
    got = as_dict(op.quantile_group(df, ["s"], "x", 3, ["sp"]), "sp", "group")
    assert got == {"a": 1, "b": 1, "c": 2, "d": 2, "e": 3, "z": None}


def test_mad_filter_uncentred(rows):
    df = rows("x double", [(v,) for v in (1.0, 2.0, 3.0, 10.0)])
    mad = op.median_abs_deviation(df, [], "x").first()[0]
    assert math.isclose(mad, 1.4826)
    assert sorted(r.x for r in op.mad_filter(df, "x").collect()) == [1.0, 2.0, 3.0]


def test_sample_n_repeatable(rows):
    df = rows("k int", [(i,) for i in range(50)])
    a = {r.k for r in op.sample_n(df, 7, ["k"], 1).collect()}
    assert len(a) == 7 and a == {r.k for r in op.sample_n(df.repartition(9), 7, ["k"], 1).collect()}
    assert a != {r.k for r in op.sample_n(df, 7, ["k"], 2).collect()}


# --- richness, cover ---


def test_conditional_richness(rows):
    df = rows("u int, Taxon string, c string", [(1, "a", "Dominant"), (1, "a", "Dominant"), (1, "b", None)])
    preds = {"dom": F.col("c") == "Dominant"}
    assert op.richness_by(df, ["u"], "Taxon", preds).first()["sr_dom"] == 1
    assert op.richness_by(df, ["u"], "Taxon", preds, na_as_level=True).first()["sr_dom"] == 2


def test_richness_many_conditions(rows):
    df = rows("u int, Taxon string, k int", [(1, f"t{i}", i) for i in range(70)])
    preds = {f"k{i}": F.col("k") >= i for i in range(70)}
    got = op.richness_by(df, ["u"], "Taxon", preds).first()
    assert [got[f"sr_k{i}"] for i in range(70)] == [70 - i for i in range(70)]


def test_cover_by(rows):
    df = rows("u int, c string, x double", [(1, "d", 1.0), (1, None, 2.0), (2, "r", 4.0)])
    preds = {"d": F.col("c") == "d"}
    assert as_dict(op.cover_by(df, ["u"], "x", preds), "u", "cover_d") == {1: 1.0, 2: 0.0}
    assert as_dict(op.cover_by(df, ["u"], "x", preds, na_rm=False), "u", "cover_d") == {1: None, 2: 0.0}


def test_dominance_index(rows):
    ddl = "site_code string, plot int, year int, year_trt int, Taxon string, live int, max_cover double"
    data = [("A", 1, 2000, 0, "a", 1, 1.0), ("A", 1, 2000, 0, "b", 1, 1.0), ("A", 1, 2001, 1, "c", 1, 2.0)]
    data += [("A", p, 2000, 0, "a", 1, 3.0) for p in (2, 3)] + [("A", 4, 2000, 0, "b", 1, 3.0)]
    got = {(r.plot, r.Taxon): r for r in op.dominance_index(rows(ddl, data)).collect()}
    assert got[(1, "a")].rel_t0 == 0.5 and got[(1, "a")].rel_freq == 0.75 and got[(1, "a")].di == 0.625
    assert got[(1, "a")].di_class == "Subordinate" and got[(2, "a")].di_class == "Dominant"
    assert got[(1, "c")].di is None and got[(1, "c")].rel_freq == 0.0


def test_rel_freq_denominators(rows):
    df = rows("site_code string, plot int, year_trt int, Taxon string", [("A", 2, 0, "a"), ("A", 4, 0, "b"), ("A", 4, 1, "c")])
    by_count = as_dict(op.rel_freq_space(df), "Taxon", "rel_freq")
    assert by_count == {"a": 0.5, "b": 0.5, "c": 0.0}
    assert as_dict(op.rel_freq_space(df, denominator="max"), "Taxon", "rel_freq")["a"] == 0.25


# --- summaries ---


def test_bar_stats(rows):
    df = rows("g string, x double", [("g", 1.0), ("g", 3.0), ("h", 5.0)])
    got = {r.g: r for r in op.bar_stats(df, "x", ["g"]).collect()}
    assert (got["g"].n, got["g"].mean) == (2, 2.0) and math.isclose(got["g"].sd, math.sqrt(2))
    assert math.isclose(got["g"].se, 1.0) and got["h"].sd is None and got["h"].se is None


def test_six_num(rows):
    got = {r.column: r for r in op.six_num(rows("x double, y int", [(1.0, 1), (2.0, 1), (3.0, 1), (10.0, None)]), ["x", "y"]).collect()}
    assert (got["x"].min, got["x"].q1, got["x"].median, got["x"].q3, got["x"].max) == (1.0, 1.75, 2.5, 4.75, 10.0)
    assert got["y"].n_null == 1 and got["x"].mean == 4.0


def test_histogram_last_bin_closed(rows):
    got = as_dict(op.histogram(rows("x double", [(float(v),) for v in (0, 1, 2, 3, 4)]), "x", 2), "bin", "n")
    assert got == {1: 2, 2: 3}


def test_box_stats(rows):
    df = rows("g int, x double", [(1, float(v)) for v in (1, 2, 3, 4, 100)])
    r = op.box_stats(df, "x", ["g"]).first()
    assert (r.q1, r["median"], r.q3, r.lo_whisker, r.hi_whisker, r.n_out) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)


def test_prop_and_crosstab(rows):
    df = rows("t string, f int", [("a", 1), ("a", 0), ("a", None), ("b", 1)])
    assert as_dict(op.prop_by(df, "f", ["t"]), "t", "prop") == {"a": 0.5, "b": 1.0}
    assert as_dict(op.crosstab(df, "t", "f", [0, 1]), "t", "n_1") == {"a": 1, "b": 1}


def test_kept_ratio(rows):
    a = rows("s int", [(1,), (1,), (2,), (3,)])
    r = op.kept_ratio(a, a.where("s = 1"), "s").first()
    assert (r.row_ratio, round(r.study_ratio, 6)) == (0.5, round(1 / 3, 6))


# --- effects ---


def test_vs_control_corrected(rows):
    df = rows("k string, trt string, v double", [("a", "Control", 0.0), ("a", "N", 0.0), ("b", "Control", 0.0), ("b", "N", 0.5)])
    assert as_dict(op.vs_control(df, ["k"], "v", how="corrected"), "k", "v_diff") == {"a": 0.0, "b": 1.0}


def test_vs_control_many_controls_no_fan_out(rows):
    df = rows("k string, trt string, v double", [("a", "Control", 1.0), ("a", "Control", 3.0), ("a", "N", 5.0)])
    out = op.vs_control(df, ["k"], "v")
    assert out.count() == 1 and out.first()["v_diff"] == 3.0


def test_mean_difference(rows):
    ddl = "site_code string, plot int, year_trt int, trt string, cls string, m double"
    data = [("A", 1, 1, "Control", "x", 2.0), ("A", 2, 1, "N", "x", 3.0), ("A", 2, 0, "N", "x", 99.0)]
    out = op.metric_diff_by_group(rows(ddl, data), "m", "cls")
    assert [(r.trt, r["diff"]) for r in out.collect()] == [("N", 50.0)]


# --- coverage, series ---


def test_coverage(rows):
    df = rows("k string, n int", [("a", 1), ("a", 1), ("a", 2), ("a", 6), ("b", 1), ("b", 4), ("c", 3), ("d", 1)])
    got = {r.k: r for r in op.coverage(df, ["k"], "n").collect()}
    assert (got["a"].f1, got["a"].f2, got["a"].n_total) == (2, 1, 10) and math.isclose(got["a"].chat, 0.82)
    assert math.isclose(got["b"].chat_corrected, 1 - 0.2 * 4 / 6)
    assert got["c"].chat is None and got["c"].chat_corrected == 1.0 and got["c"].sc == 1.0
    assert got["d"].chat_corrected == 1.0


def test_fixed_locations(rows):
    data = [(1, y, 10.0, 20.0) for y in (1, 2)] + [(2, 1, 10.0, 20.0), (2, 2, 11.0, 20.0)]
    out = op.fixed_locations(rows("STUDY_ID int, YEAR int, LATITUDE double, LONGITUDE double", data))
    assert [r.STUDY_ID for r in out.collect()] == [1]


def test_loss_table(rows):
    df = rows(
        "STUDY_ID int, MEASURE string, GENUS_SPECIES string, YEAR int, SUM_VALUE double",
        [(1, "A", "a", y, v) for y, v in enumerate([4.0, 0.0, 3.0, 0.0])] + [(1, "A", "b", y, float(y)) for y in range(4)],
    )
    r = [x for x in op.loss_summary(df).collect()]
    assert len(r) == 1 and (r[0].n_year, r[0].n_zeros, r[0].lost_at_end, r[0].frac_missing_after_t0) == (4, 2, 1, 0.5)


def test_long_measures_drop_unrecorded(rows):
    df = rows("STUDY_ID int, Abundance double, Biomass double", [(1, 2.0, 0.0), (2, 1.0, 5.0)])
    got = {(r.STUDY_ID, r.MEASURE) for r in op.long_measures(df).collect()}
    assert got == {(1, "Abundance"), (2, "Abundance"), (2, "Biomass")}


# --- events, turnover ---


def test_turnover(rows):
    df = rows("u int, t int, sp string", [(1, 0, "a"), (1, 0, "b"), (1, 1, "b"), (1, 1, "c"), (1, 2, "c")])
    r = {x.t: (x.appear, x.disappear, x.total) for x in op.turnover(df, ["u"], "t", "sp").collect()}
    assert r == {1: (1, 1, 3), 2: (1, 2, 3)}
    r = {x.t: (x.appear, x.disappear, x.total) for x in op.turnover(df, ["u"], "t", "sp", "previous").collect()}
    assert r == {1: (1, 1, 3), 2: (0, 1, 2)}


def test_first_event_one_row(rows):
    df = rows("u int, t int, f boolean", [(1, 2, True), (1, 2, True), (1, 3, True), (2, 1, None)])
    events = op.first_event(df, ["u"], "t", "f")
    assert [(r.u, r.first_time) for r in events.collect()] == [(1, 2)]
    assert op.before_after(df, events, ["u"], "t").count() == 3


# --- files ---


def test_wide_ingest(rows):
    df = rows("plot int, `sp.A` double, `sp.B` double, other double", [(1, 3.0, 0.0, 9.0)])
    assert [(r.Taxon, r.max_cover) for r in files.ingest_wide(df, ["plot"]).collect()] == [("A", 3.0)]


def test_csv_and_table_round_trip(spark, rows, tmp_path):
    df = rows("site_code string, plot int, year_trt int, anpp string", [("A", 1, 0, "1.5"), ("NULL", 2, 1, None)])
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_panel_csv(spark, str(tmp_path / "c"), "site_code string, plot int, year_trt int, anpp string", numeric=["anpp"])
    assert {(r.site_code, r.anpp) for r in back.collect()} == {("A", 1.5), ("NULL", None)}
    files.write_table(back, str(tmp_path / "t"), ["site_code"])
    again = files.read_table(spark, str(tmp_path / "t"), ["plot", "anpp"])
    assert again.columns == ["plot", "anpp"] and again.count() == 2


def test_schemas_parse():
    from pyspark.sql.types import StructType

    for name in ("COVER_DDL", "PLOT_YEAR_DDL", "BIOMASS_DDL", "SERIES_DDL", "SERIES_META_DDL"):
        assert len(StructType.fromDDL(getattr(schemas, name)).fields) > 2


def test_losses_see_surveys_without_cover(rows):
    data = [("s", "p", "N", t, 0, c) for t, c in (("a", 0.5), ("b", 0.3), ("c", 0.2))]
    data += [("s", "p", "N", t, 1, 0.0) for t in "abc"] + [("s", "p", "N", "a", 2, 1.0), ("s", "p", "N", "a", 2, 1.0)]
    live = rows("site_code string, plot string, trt string, Taxon string, year_trt int, rel_cover double", data)
    got = {(r.Taxon, r.year_trt): r.lost for r in op.lagged_loss_set(live, ["N"]).collect()}
    assert got == {("a", 1): 1, ("b", 1): 1}


def test_years_absent_averages_subplots(rows):
    data = [("s", "p", "N", "a", y, 0.5) for y in (0, 1, 1, 2, 2)] + [("s", "p", "N", "b", y, c) for y, c in ((0, 0.5), (1, 0.0), (1, 0.2), (2, 0.1))]
    live = rows("site_code string, plot string, trt string, Taxon string, year_trt int, rel_cover double", data)
    got = {r.Taxon: (r.years_present, r.yrs_absent) for r in op.years_absent(live).collect()}
    assert got == {"a": (2.0, 0.0), "b": (1.5, 0.25)}
