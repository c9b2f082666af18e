"""Seeded random panels against small plain-Python models."""

import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from sward import operators as op


def random_panel(seed, sites=3, plots=4, years=5, species=6):
    r = random.Random(seed)
    return [
        (f"S{s}", s * 10 + p, y, "N" if p % 2 else "Control", f"t{k}", float(r.randint(1, 4)))
        for s in range(sites)
        for p in range(plots)
        for y in range(years)
        for k in range(species)
        if r.random() < 0.55
    ]


DDL = "site_code string, plot int, year_trt int, trt string, Taxon string, rel_cover double"


@pytest.mark.parametrize("seed", [1, 2])
def test_completion_runs_losses_turnover(spark, seed):
    data = random_panel(seed)
    df = spark.createDataFrame(data, DDL)
    panel = op.complete_panel(df, ["site_code"], ["plot", "year_trt", "trt"], "Taxon", "rel_cover").cache()
    got = as_dict(panel, ["plot", "year_trt", "Taxon"], "rel_cover")

    surveys, pool, facts = defaultdict(set), defaultdict(set), {}
    for site, plot, year, _, taxon, x in data:
        surveys[(site, plot)].add(year)
        pool[site].add(taxon)
        facts[(plot, year, taxon)] = x
    want = {
        (plot, y, t): facts.get((plot, y, t), 0.0)
        for (site, plot), ys in surveys.items()
        for y in ys
        for t in pool[site]
    }
    assert got == want

    longest = as_dict(
        op.absence_runs(panel, ["plot", "Taxon"], "year_trt", longest=True), ["plot", "Taxon"], "cons_abs_max"
    )
    lost = as_dict(op.losses(panel, ["plot", "Taxon"], "year_trt", "rel_cover"), ["plot", "Taxon", "year_trt"], "lost")
    want_lost = {}
    for (site, plot), ys in surveys.items():
        for t in pool[site]:
            run = best = 0
            prev = None
            for y in sorted(ys):
                x = want[(plot, y, t)]
                run = 0 if x else run + 1
                best = max(best, run)
                if prev:
                    want_lost[(plot, t, y)] = int(x == 0)
                prev = x
            assert longest[(plot, t)] == best
    assert lost == want_lost

    turn = {
        (r.plot, r.year_trt): (r.appear, r.disappear, r.total)
        for r in op.turnover(df, ["plot"], "year_trt", "Taxon").collect()
    }
    by = defaultdict(lambda: defaultdict(set))
    for _, plot, year, _, taxon, _ in data:
        by[plot][year].add(taxon)
    want_turn = {}
    for plot, ys in by.items():
        first = ys[min(ys)]
        for y in sorted(ys)[1:]:
            want_turn[(plot, y)] = (len(ys[y] - first), len(first - ys[y]), len(first | ys[y]))
    assert turn == want_turn
    panel.unpersist()


def test_sparse_loss_tables_equal_dense_ones(spark):
    df = spark.createDataFrame(random_panel(5), DDL)
    df = df.withColumn("cls", F.when(F.col("Taxon") < "t3", "x").when(F.col("Taxon") < "t5", "y"))
    panel = op.complete_panel(df, ["site_code"], ["plot", "year_trt", "trt"], "Taxon", "rel_cover")
    classes = df.select("site_code", "plot", "Taxon", "cls").distinct()
    dense = op.prop_lost(panel.join(classes, ["site_code", "plot", "Taxon"]), "cls")

    def table(d):
        return sorted(
            (r.year_trt, r.trt, r.cls, r.n, round(r.mean_prop_lost, 9), r.sd_prop_lost and round(r.sd_prop_lost, 9))
            for r in d.collect()
        )

    assert table(dense) == table(op.prop_lost_sparse(df, "cls"))


def skewed(seed, n=4000):
    """One group holds most rows, one value holds a third of them, and some values are missing."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        g = "hot" if r.random() < 0.8 else f"g{r.randint(0, 3)}"
        x = 7.0 if r.random() < 0.33 else (None if r.random() < 0.02 else round(r.gauss(0, 50), 1))
        out.append((g, i, x))
    return out


def test_quantiles_and_ranks_under_skew(spark):
    data = skewed(3)
    df = spark.createDataFrame(data, "g string, i int, x double").repartition(6)
    groups = defaultdict(list)
    for g, _, x in data:
        if x is not None:
            groups[g].append(x)
    q = {r.g: r for r in op.exact_quantiles(df, ["g"], "x", {"a": 0.1, "b": 0.5, "c": 0.97}).collect()}
    for g, xs in groups.items():
        for name, p in (("a", 0.1), ("b", 0.5), ("c", 0.97)):
            assert q[g][name] == pytest.approx(np.quantile(xs, p))
    whole = op.exact_quantiles(df, [], "x", {"m": 0.5, "z": 0.999}).first()
    every = [x for xs in groups.values() for x in xs]
    assert whole.m == pytest.approx(np.quantile(every, 0.5)) and whole.z == pytest.approx(np.quantile(every, 0.999))

    a = as_dict(op.min_rank(df, ["g"], "x"), "i", "rank")
    b = as_dict(op.min_rank(df, ["g"], "x", bounded=False), "i", "rank")
    assert a == b
    for g, i, x in data[:300]:
        assert a[i] == (None if x is None else 1 + sum(v < x for v in groups[g]))


def test_completion_with_hot_site(spark):
    data = [("hot", p, y, "N", f"t{(p + y + k) % 9}", 1.0) for p in range(60) for y in range(3) for k in range(3)]
    data += [("cold", 999, 0, "N", "t1", 1.0)]
    df = spark.createDataFrame(data, DDL)
    for limit in ("-1", "10m"):  # the lists joined by key, then broadcast
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            out = op.complete_panel(df, ["site_code"], ["plot", "year_trt"], "Taxon", "rel_cover", block=2)
            assert out.count() == 60 * 3 * 9 + 1
            assert out.where("pa = 1").count() == 60 * 3 * 3 + 1
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_starts_and_filters_with_a_heavy_group(spark, limit):
    r = random.Random(5)
    data = [("hot" if r.random() < 0.4 else f"g{r.randrange(900)}", r.randrange(1990, 2020), r.choice("ab"), r.choice([0.0, 1.0])) for _ in range(3000)] + [(None, 2000, "a", 1.0)]
    df = spark.createDataFrame(data, "g string, y int, m string, v double").repartition(5)
    by = defaultdict(list)
    for g, y, m, v in data:
        by[g].append((y, m, v))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        got = op.years_since_start(df, ["g"], "y", 1).collect()
        assert len(got) == len(data) and all(r.std_year == (None if r.g is None else r.y - min(by[r.g])[0] + 1) for r in got)
        kept = op.keep_groups(df, ["g"], min_distinct={"y": 3}, levels={"m": 2}, nonzero="v").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    good = {g for g, own in by.items() if g and len({y for y, *_ in own}) >= 3 and len({m for _, m, _ in own}) == 2 and sum(v for *_, v in own)}
    assert sorted((x.g, x.y, x.m, x.v) for x in kept) == sorted(d for d in data if d[0] in good) and "hot" in good and len(good) < len(by)
