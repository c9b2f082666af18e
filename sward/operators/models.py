"""Trend and loss models as distributed aggregations.

Straight lines, fixed-effect trends and quadratics come from sums per group. Logistic curves and models with several terms,
per group or over all rows, take damped Newton rounds: each is one grouping of sums of products over rows compacted to
distinct covariate values, solved inside the plan, and reads only groups that have not settled. Effects that vary between
studies are pooled in two stages (inverse variance, random effects by the method of moments): this is an approximation to a
mixed model, not its likelihood.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sward.functions.semantics import safe_div
from sward.operators.order import attach, meet
from sward.session import settle


def ols_by(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """Straight line per group: intercept, slope, their covariance, r2 and n. NULL where x does not vary."""
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    m = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("_mx"),
        F.avg(y).alias("_my"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_sxy(y, x).alias("_sxy"),
        F.regr_syy(y, x).alias("_syy"),
    )
    m = m.withColumn("b1", safe_div("_sxy", "_sxx"))
    m = m.withColumn("b0", F.col("_my") - F.col("b1") * F.col("_mx"))
    rss = F.greatest(F.lit(0.0), F.col("_syy") - F.col("b1") * F.col("_sxy"))
    m = m.withColumn("_s2", F.when(F.col("n") > 2, safe_div(rss, F.col("n") - 2)))
    m = m.withColumn("v11", safe_div("_s2", "_sxx"))
    return m.select(
        *by,
        "n",
        "b0",
        "b1",
        (F.col("_s2") / F.col("n") + F.col("_mx") * F.col("_mx") * F.col("v11")).alias("v00"),
        (-F.col("_mx") * F.col("v11")).alias("v01"),
        "v11",
        F.sqrt("v11").alias("se_b1"),
        safe_div(F.col("_sxy") * F.col("_sxy"), F.col("_sxx") * F.col("_syy")).alias("r2"),
    )


def fe_trend(df: DataFrame, y: str, t: str, entity: Sequence[str]) -> DataFrame:
    """One slope over time with a fixed effect per entity: within sums of squares are formed per entity and added up."""
    per = df.where(F.col(y).isNotNull() & F.col(t).isNotNull()).groupBy(*entity).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_sxx(y, t).alias("sxx"),
        F.regr_sxy(y, t).alias("sxy"),
        F.regr_syy(y, t).alias("syy"),
    )
    tot = per.agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("n_entities"),
        F.sum("sxx").alias("sxx"),
        F.sum("sxy").alias("sxy"),
        F.sum("syy").alias("syy"),
    ).withColumn("slope", safe_div("sxy", "sxx"))
    df_resid = F.col("n") - F.col("n_entities") - 1
    rss = F.col("syy") - F.col("slope") * F.col("sxy")
    return tot.select(
        "n", "n_entities", "slope", F.sqrt(safe_div(safe_div(rss, df_resid), "sxx")).alias("se")
    )


def site_slopes(df: DataFrame, y: str, t: str, entity: str) -> DataFrame:
    """A slope per entity with one common intercept, from group sums in closed form."""
    s = df.where(F.col(y).isNotNull() & F.col(t).isNotNull()).groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(t).alias("st"),
        F.sum(F.col(t) * F.col(t)).alias("stt"),
        F.sum(y).alias("sy"),
        F.sum(F.col(t) * F.col(y)).alias("sty"),
    )
    whole = s.agg(
        safe_div(
            F.sum("sy") - F.sum(F.coalesce(safe_div(F.col("sty") * F.col("st"), "stt"), F.lit(0.0))),
            F.sum("n") - F.sum(F.coalesce(safe_div(F.col("st") * F.col("st"), "stt"), F.lit(0.0))),
        ).alias("intercept")
    )
    return attach(s, whole, []).select(
        entity, "n", "intercept", safe_div(F.col("sty") - F.col("intercept") * F.col("st"), "stt").alias("slope")
    )


def quad_by(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """y = c0 + c1 x + c2 x^2 per group; NULL with fewer than three distinct x.

    x is centred and scaled within its group before moments are formed, and the coefficients are turned back, so neither
    the origin nor the unit of x matters."""
    rows = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    rows = rows.where("_x IS NOT NULL AND _y IS NOT NULL")
    spread = F.coalesce(F.nullif(F.stddev_pop("_x"), F.lit(0.0)), F.lit(1.0))
    centre = settle(rows.groupBy(*by).agg(F.avg("_x").alias("_m"), spread.alias("_s")), "centres")
    z = attach(rows, centre, by).withColumn("_z", (F.col("_x") - F.col("_m")) / F.col("_s"))
    zc, yc = F.col("_z"), F.col("_y")
    m = z.groupBy(*by, "_m", "_s").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.pow(zc, F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)],
        F.avg(yc).alias("t0"),
        F.avg(zc * yc).alias("t1"),
        F.avg(zc * zc * yc).alias("t2"),
    )
    one, s1, s2, s3, s4, t0, t1, t2 = (F.lit(1.0), *(F.col(c) for c in ("s1", "s2", "s3", "s4", "t0", "t1", "t2")))

    def det(a, b, c):
        return (
            a[0] * (b[1] * c[2] - b[2] * c[1])
            - a[1] * (b[0] * c[2] - b[2] * c[0])
            + a[2] * (b[0] * c[1] - b[1] * c[0])
        )

    d = det((one, s1, s2), (s1, s2, s3), (s2, s3, s4))
    ok = F.when(F.abs(d) > 1e-9, d)  # of a scaled x, so free of units
    g = m.select(
        *by,
        "n",
        "_m",
        safe_div(det((t0, s1, s2), (t1, s2, s3), (t2, s3, s4)), ok).alias("_g0"),
        (safe_div(det((one, t0, s2), (s1, t1, s3), (s2, t2, s4)), ok) / F.col("_s")).alias("_g1"),
        (safe_div(det((one, s1, t0), (s1, s2, t1), (s2, s3, t2)), ok) / (F.col("_s") * F.col("_s"))).alias("_g2"),
    )
    return g.select(
        *by,
        "n",
        (F.col("_g0") - F.col("_g1") * F.col("_m") + F.col("_g2") * F.col("_m") * F.col("_m")).alias("c0"),
        (F.col("_g1") - 2 * F.col("_g2") * F.col("_m")).alias("c1"),
        F.col("_g2").alias("c2"),
    )


# --- generalised linear models ----------------------------------------------------------------------------------

SETTLED = 1e-10
SINGULAR = 1e-12
HALVINGS = 60


def _softplus(e: Column) -> Column:
    """ln(1 + exp(e)) without overflow."""
    return F.greatest(e, F.lit(0.0)) + F.log1p(F.exp(-F.abs(e)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def inverse(m: Column, k: int) -> Column:
    """Inverse of a symmetric positive k x k matrix, an array of rows; NULL if it is singular.

    The matrix is scaled to a unit diagonal and eliminated pivot by pivot next to a unit matrix, inside the plan."""
    scale = F.transform(m, lambda row, i: F.when(F.element_at(row, i + 1) > 0, 1 / F.sqrt(F.element_at(row, i + 1))))

    def start(row: Column, i: Column) -> Column:
        scaled = F.zip_with(row, scale, lambda x, z: x * z * F.element_at(scale, i + 1))
        return F.concat(scaled, F.transform(row, lambda x, j: F.when(i == j, 1.0).otherwise(0.0)))

    def eliminate(whole: Column, p: Column) -> Column:
        pivot = F.element_at(whole, p)
        by = F.when(F.element_at(pivot, p) > SINGULAR, F.element_at(pivot, p))
        return F.transform(
            whole,
            lambda row, i: F.when(i + 1 == p, F.transform(row, lambda x: x / by)).otherwise(
                F.zip_with(row, pivot, lambda x, y: x - F.element_at(row, p) * y / by)
            ),
        )

    done = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.transform(m, start), eliminate)
    rows = F.transform(done, lambda row, i: F.zip_with(F.slice(row, k + 1, k), scale, lambda x, z: x * z * F.element_at(scale, i + 1)))
    return F.when(F.forall(F.flatten(rows), lambda x: x.isNotNull()), rows)


def _round(rows: DataFrame, state: DataFrame, by: list[str], xs: list[str], family: str) -> DataFrame:
    """One pass over the rows of the groups in ``state``: the likelihood at the proposed point, and the next proposal. A point
    that is worse than the one before is taken back and half its step is proposed."""
    d = meet(rows, state, by) if by else rows.crossJoin(F.broadcast(state))  # without keys the state is one row
    k = len(xs)
    d = d.withColumn("_eta", F.expr(" + ".join(f"_at[{i}] * {x}" for i, x in enumerate(xs))))
    if family == "binomial":
        d = d.withColumn("_p", F.expr("1 / (1 + exp(-_eta))"))
        v, r, value = "_m * _p * (1 - _p)", "_s - _m * _p", F.col("_s") * F.col("_eta") - F.col("_m") * _softplus(F.col("_eta"))
    else:
        v, r, value = "_m", "_s - _m * _eta", F.expr("-(_s - _m * _eta) * (_s - _m * _eta) / (2 * _m)")
    d = d.withColumns({"_v": F.expr(v), "_r": F.expr(r), "_ll": value})
    kept = ("_at", "_base", "_value", "_step", "_halved", "_cov")
    sums = d.groupBy(*by).agg(
        F.first(F.struct(*kept)).alias("_was"),
        F.sum("_ll").alias("_new"),
        *[F.expr(f"sum(_r * {x}) AS _g{i}") for i, x in enumerate(xs)],
        *[F.expr(f"sum(_v * {xs[i]} * {xs[j]}) AS _h{i}_{j}") for i in range(k) for j in range(i, k)],
    )
    was = {c: F.col(f"_was.{c}") for c in kept}
    good = was["_value"].isNull() | (F.col("_new") >= was["_value"] - 1e-9 * (1 + F.abs(was["_value"])))
    gradient = F.expr(f"array({', '.join(f'_g{i}' for i in range(k))})")
    matrix = F.expr(f"array({', '.join('array(' + ', '.join(f'_h{min(i, j)}_{max(i, j)}' for j in range(k)) + ')' for i in range(k))})")
    s = sums.select(*by, "_was", "_new", gradient.alias("_g"), good.alias("_good"), inverse(matrix, k).alias("_inv"))
    newton = F.transform("_inv", lambda row: _dot(row, F.col("_g")))
    s = s.withColumn("_next", F.when(F.col("_good"), newton).otherwise(F.transform(was["_step"], lambda z: z / 2)))
    base = F.when(F.col("_good"), was["_at"]).otherwise(was["_base"])
    return s.select(
        *by,
        F.zip_with(base, "_next", lambda b, z: b + z).alias("_at"),
        base.alias("_base"),
        F.when(F.col("_good"), F.col("_new")).otherwise(was["_value"]).alias("_value"),
        F.col("_next").alias("_step"),
        F.when(F.col("_good"), F.lit(0)).otherwise(was["_halved"] + 1).alias("_halved"),
        F.when(F.col("_good"), F.col("_inv")).otherwise(was["_cov"]).alias("_cov"),
    )


def _size(step: str, base: str) -> Column:
    """Largest step, relative to its coefficient where that is above one."""
    return F.array_max(F.zip_with(step, base, lambda z, b: F.abs(z) / (1 + F.abs(b))))


def newton(rows: DataFrame, start: DataFrame, by: Sequence[str], xs: Sequence[str], family: str = "binomial", rounds: int = 100, every: int = 2) -> DataFrame:
    """Damped Newton fits, one for each row of ``start`` (``by`` and the array ``_at``, one number for each of ``xs``).

    ``rows`` is a stored table of ``by``, ``xs``, ``_m`` trials and ``_s`` successes (or the value and 1). A round is one
    grouping. After ``every`` rounds the state is stored; groups that have settled, or cannot be fitted, leave it, and once
    they are half of all their rows leave the table that the rounds read. Returns ``by``, coefficients ``_b``, the inverse of
    the information ``_cov``, ``_value`` (log-likelihood, or minus half the residual sum of squares) and ``settled``.
    """
    by, xs = list(by), list(xs)
    none = F.lit(None)
    state = start.select(
        *by,
        "_at",
        F.col("_at").alias("_base"),
        none.cast("double").alias("_value"),
        none.cast("array<double>").alias("_step"),
        F.lit(0).alias("_halved"),
        none.cast("array<array<double>>").alias("_cov"),
    )
    held, n_open = None, 1
    done: list[DataFrame] = []
    for _ in range(0, rounds, every):
        if not n_open:
            break
        for _ in range(every):
            state = _round(rows, state, by, xs, family)
        lost = F.col("_step").isNull() | (F.col("_halved") > HALVINGS)
        settled = F.coalesce(_size("_step", "_base") < SETTLED, F.lit(False)) & (F.col("_halved") == 0)
        state = settle(state.withColumn("settled", settled).withColumn("_open", ~settled & ~lost), "fit_state")
        done.append(state.where("NOT _open"))
        state = state.where("_open")
        n_open = state.count()
        if by and n_open:
            held = start.count() if held is None else held
            if n_open <= held // 2:
                rows, held = settle(meet(rows, state.select(*by), by), "fit_rows"), n_open
    if n_open:
        done.append(state)
    out = reduce(DataFrame.unionByName, [d.select(*by, "_at", "_cov", "_value", "settled") for d in done])
    return out.withColumnRenamed("_at", "_b")


def logit_by(
    df: DataFrame, by: Sequence[str], y: str, x: str, w: str | None = None, rounds: int = 100, every: int = 2
) -> DataFrame:
    """Logistic curve per group (one curve for ``by=[]``), optionally weighted.

    y is 0/1, or a fraction of ``w`` trials. Rows are first compacted to distinct (group, x). Every group
    comes out with a ``status``: ``fitted``; ``one outcome``, ``one x`` or ``separated`` (a cut of x parts the outcomes), which
    have no finite estimate and NULL coefficients; ``not settled`` after ``rounds`` rounds, a guard against endless ones.
    Returns coefficients, covariance, log-likelihood and n.
    """
    by = list(by)
    weight = F.col(w) if w else F.lit(1.0)
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    compact = rows.groupBy(*by, F.col(x).cast("double").alias("_x")).agg(
        F.sum(weight.cast("double")).alias("_m"), F.sum(weight * F.col(y)).cast("double").alias("_s")
    )
    compact = settle(compact.withColumn("_one", F.lit(1.0)), "logit_rows")
    ends = [
        f(F.when(c, F.col("_x"))).alias(n + tag)
        for c, tag in ((F.col("_s") > 0, "1"), (F.col("_s") < F.col("_m"), "0"))
        for f, n in ((F.min, "_lo"), (F.max, "_hi"))
    ]
    whole = [F.sum("_m").alias("_n"), F.sum("_s").alias("_ts"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]
    status = (
        F.when(F.col("_lo1").isNull() | F.col("_lo0").isNull(), "one outcome")
        .when(F.col("_lo") == F.col("_hi"), "one x")
        .when((F.col("_hi1") <= F.col("_lo0")) | (F.col("_hi0") <= F.col("_lo1")), "separated")
        .otherwise("fitted")
    )
    groups = settle(compact.groupBy(*by).agg(*whole, *ends).select(*by, "_n", "_ts", status.alias("status")), "logit_groups")
    start = groups.where("status = 'fitted'").select(*by, F.array(F.ln(F.col("_ts") / (F.col("_n") - F.col("_ts"))), F.lit(0.0)).alias("_at"))
    fits = newton(compact, start, by, ["_one", "_x"], rounds=rounds, every=every)
    if by:
        names = {k: f"_key_{i}" for i, k in enumerate(by)}
        on = [F.col(f"g.{k}").eqNullSafe(F.col(n)) for k, n in names.items()]
        out = groups.alias("g").join(fits.withColumnsRenamed(names), on, "left")
    else:
        out = groups.join(F.broadcast(fits), how="left")  # one row each
    found = F.coalesce("settled", F.lit(False))
    cov = F.col("_cov")
    values = {"b0": F.col("_b")[0], "b1": F.col("_b")[1], "v00": cov[0][0], "v01": cov[0][1], "v11": cov[1][1], "se_b1": F.sqrt(cov[1][1]), "loglik": F.col("_value")}
    shown = F.when((F.col("status") == "fitted") & ~found, "not settled").otherwise(F.col("status"))
    return out.select(*by, F.col("_n").alias("n"), *[F.when(found, v).alias(c) for c, v in values.items()], found.alias("converged"), shown.alias("status"))


def pooled_logit(df: DataFrame, y: str, x: str, w: str | None = None, rounds: int = 100) -> DataFrame:
    """One logistic curve over all rows."""
    return logit_by(df, [], y, x, w, rounds)


def two_stage_effect(coef: DataFrame, b: str = "b1", v: str = "v11") -> DataFrame:
    """Random-effects mean of per-study coefficients: pooled effect, se, between-study variance, heterogeneity Q and k."""
    rows = coef.where(F.col(b).isNotNull() & (F.col(v) > 0))
    w = 1 / F.col(v)
    m = rows.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(w).alias("sw"),
        F.sum(w * w).alias("sww"),
        F.sum(w * F.col(b)).alias("swb"),
        F.sum(w * F.col(b) * F.col(b)).alias("swbb"),
    )
    m = m.withColumn("q", F.col("swbb") - safe_div(F.col("swb") * F.col("swb"), "sw"))
    m = m.withColumn(
        "tau2",
        F.greatest(
            F.lit(0.0),
            F.coalesce(
                safe_div(F.col("q") - (F.col("k") - 1), F.col("sw") - safe_div("sww", "sw")), F.lit(0.0)
            ),
        ),
    ).select("k", "q", "tau2")
    second = attach(rows.select(b, v), m, [])
    w2 = 1 / (F.col(v) + F.col("tau2"))
    return second.groupBy("k", "q", "tau2").agg(F.sum(w2).alias("_w"), F.sum(w2 * F.col(b)).alias("_wb")).select(
        "k",
        "q",
        "tau2",
        safe_div("_wb", "_w").alias("pooled"),
        F.sqrt(1 / F.col("_w")).alias("se"),
    )


def shrunken_slopes(coef: DataFrame, by: Sequence[str], b: str = "b1", v: str = "v11") -> DataFrame:
    """Per-study coefficients drawn toward the pooled one by their own uncertainty."""
    pooled = two_stage_effect(coef, b, v).select("tau2", "pooled")
    rows = attach(coef.where(F.col(b).isNotNull() & (F.col(v) > 0)), pooled, [])
    share = F.col("tau2") / (F.col("tau2") + F.col(v))
    return rows.select(
        *by, b, v, (share * F.col(b) + (1 - share) * F.col("pooled")).alias("shrunken"), (share).alias("weight")
    )


def residual_autocorrelation(df: DataFrame, by: Sequence[str], time: str, y: str, x: str) -> DataFrame:
    """Lag-one correlation of the residuals of a straight line per group; residuals are formed in place."""
    fit = ols_by(df, by, y, x).select(*by, "b0", "b1")
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    res = attach(rows, fit, by, "inner").withColumn("res", F.col(y) - F.col("b0") - F.col("b1") * F.col(x))
    res = res.withColumn("lag_res", F.lag("res").over(Window.partitionBy(*by).orderBy(time)))
    return (
        res.where(F.col("lag_res").isNotNull() & F.col("res").isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            safe_div(F.covar_pop("res", "lag_res"), F.stddev_pop("res") * F.stddev_pop("lag_res")).alias("lag_corr"),
        )
    )


def adjusted_means(df: DataFrame, y: str, factor: str, covariate: str) -> DataFrame:
    """Mean of y per level of a factor, adjusted to the overall mean of a covariate with a common slope."""
    rows = df.where(F.col(y).isNotNull() & F.col(covariate).isNotNull() & F.col(factor).isNotNull())
    level = rows.groupBy(factor).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("_my"),
        F.avg(covariate).alias("_mx"),
        F.regr_sxx(y, covariate).alias("_sxx"),
        F.regr_sxy(y, covariate).alias("_sxy"),
    )
    whole = level.agg(
        safe_div(F.sum("_sxy"), F.sum("_sxx")).alias("_slope"),
        safe_div(F.sum(F.col("_mx") * F.col("n")), F.sum("n")).alias("_gx"),
    )
    return attach(level, whole, []).select(
        factor,
        "n",
        F.col("_my").alias("raw_mean"),
        (F.col("_my") + F.col("_slope") * (F.col("_gx") - F.col("_mx"))).alias("adjusted_mean"),
    )


# --- models with several terms --------------------------------------------------------------------------------


def design(
    df: DataFrame, x: str, factor: str | None = None, levels: Sequence[str] = (), also: Sequence[str] = (),
    interact: bool = True,
) -> tuple[DataFrame, list[str]]:
    """Full-rank design columns: x, the other covariates, factor dummies with the first level dropped, and products of
    x (or, without a factor, of the other covariates) with x. Returns the frame and the names of its terms."""
    terms = [x, *also]
    cols: dict[str, Column] = {}
    if factor:
        for lev in levels[1:]:
            d = (F.col(factor) == lev).cast("double")
            cols[f"{factor}_{lev}"] = d
            if interact:
                cols[f"{x}_x_{factor}_{lev}"] = d * F.col(x)
    elif interact:
        for c in also:
            cols[f"{x}_x_{c}"] = F.col(x) * F.col(c)
    return df.withColumns(cols) if cols else df, [*terms, *cols]


def glm_by(df: DataFrame, by: Sequence[str], y: str, terms: Sequence[str], family: str = "binomial", w: str | None = None, rounds: int = 100) -> DataFrame:
    """A model with an intercept and several terms per group (one model for ``by=[]``): ``by``, ``n`` rows, ``k`` parameters,
    ``coef`` and ``cov`` (intercept first), ``loglik``, ``settled``.

    ``binomial``: y is 0/1, or a fraction of ``w`` trials; rows are compacted to distinct terms. ``gaussian``: least squares.
    Every round is one grouping of sums of products, solved inside the plan. Rows with a missing value are left out. A group
    with one outcome, or whose terms depend on each other, is returned with NULL estimates.
    """
    if family not in ("binomial", "gaussian"):
        raise ValueError(f"unknown family: {family}")
    by, xs = list(by), ["_one", *[f"_x{i}" for i in range(len(terms))]]
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    rows = df.select(*by, F.lit(1.0).alias("_one"), *[F.col(t).cast("double").alias(x) for t, x in zip(terms, xs[1:], strict=True)], F.col(y).cast("double").alias("_y"), weight.alias("_m"))
    rows = rows.na.drop(subset=[*xs, "_y", "_m"])
    if family == "binomial":
        rows = rows.groupBy(*by, *xs).agg(F.count(F.lit(1)).alias("_rows"), F.sum("_m").alias("_m"), F.sum(F.col("_m") * F.col("_y")).alias("_s"))
    else:
        rows = rows.withColumns({"_rows": F.lit(1).cast("long"), "_s": F.col("_m") * F.col("_y")}).drop("_y")
    rows = settle(rows, "glm_rows")
    sizes = settle(rows.groupBy(*by).agg(F.sum("_rows").alias("n"), F.sum("_m").alias("_all"), F.sum("_s").alias("_ts")), "glm_groups")
    mean = F.col("_ts") / F.col("_all")
    first = F.when((mean > 0) & (mean < 1), F.ln(mean / (1 - mean))) if family == "binomial" else mean
    start = sizes.select(*by, F.array(first, *[F.lit(0.0)] * len(terms)).alias("_at")).where("_at[0] IS NOT NULL")
    fits = newton(rows, start, by, xs, family, rounds, every=1)
    if by:
        names = {k: f"_key_{i}" for i, k in enumerate(by)}
        on = [F.col(f"g.{k}").eqNullSafe(F.col(n)) for k, n in names.items()]
        out = sizes.alias("g").join(fits.withColumnsRenamed(names), on, "left")
    else:
        out = sizes.join(F.broadcast(fits), how="left")  # one row each
    k = len(xs)
    found = F.coalesce("settled", F.lit(False))
    n = F.col("n")
    if family == "gaussian":
        rss = -2 * F.col("_value")
        noise = F.when(n > k, rss / (n - k))
        cov = F.when(noise.isNotNull(), F.transform("_cov", lambda row: F.transform(row, lambda v: v * noise)))
        value = -n / 2 * (F.ln(2 * math.pi * rss / n) + 1)
    else:
        cov, value = F.col("_cov"), F.col("_value")
    return out.select(*by, "n", F.lit(k).alias("k"), F.when(found, F.col("_b")).alias("coef"), F.when(found, cov).alias("cov"), F.when(found, value).alias("loglik"), found.alias("settled"))


def pooled_glm(df: DataFrame, y: str, terms: Sequence[str], family: str = "binomial", w: str | None = None) -> dict:
    """One model over all rows: the table of :func:`glm_by` with the names of its terms."""
    return {"fit": settle(glm_by(df, [], y, terms, family, w), "glm"), "terms": list(terms), "family": family}


def normal_tails(z: Column) -> Column:
    """Chance of a standard normal value at least as far from 0 as z: a series up to 3, a continued fraction beyond."""
    a = F.abs(z)
    density = F.exp(-a * a / 2) * F.lit(1 / math.sqrt(2 * math.pi))
    series = F.aggregate(F.array(*[F.lit(float(n)) for n in range(121, 1, -2)]), F.lit(1.0), lambda s, n: 1 + s * a * a / n)
    fraction = F.aggregate(F.array(*[F.lit(float(n)) for n in range(80, 0, -1)]), a, lambda s, n: a + n / s)
    return F.when(a < 3, 1 - 2 * density * a * series).otherwise(2 * density / fraction)


def t_tails(t: Column, nu: Column) -> Column:
    """The same for Student's t, by its expansion into a normal value; at least six digits from 20 degrees of freedom on."""
    b = 48 * (nu - 0.5) * (nu - 0.5)
    y = (nu - 0.5) * F.log1p(t * t / nu)
    more = ((((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b) + y + 3.0) / b + 1.0
    return normal_tails(more * F.sqrt(y))


def coefficient_rows(fits: DataFrame, by: Sequence[str], terms: Sequence[str], family: str = "binomial") -> DataFrame:
    """Estimate, standard error, statistic and p-value of each term of each model of :func:`glm_by`."""
    names = ["(Intercept)", *terms]
    each = fits.select(*by, "n", "k", "coef", "cov", F.explode(F.arrays_zip(F.array(*[F.lit(t) for t in names]).alias("term"), F.sequence(F.lit(1), F.lit(len(names))).alias("i"))).alias("_t"))
    se = F.sqrt(F.element_at(F.element_at("cov", F.col("_t.i")), F.col("_t.i")))
    rows = each.select(*by, "n", "k", F.col("_t.term").alias("term"), F.element_at("coef", F.col("_t.i")).alias("estimate"), se.alias("se"))
    rows = rows.withColumn("statistic", safe_div("estimate", "se"))
    p = normal_tails(F.col("statistic")) if family == "binomial" else t_tails(F.col("statistic"), F.col("n") - F.col("k"))
    return rows.select(*by, "term", "estimate", "se", "statistic", p.alias("p_value"))


def coefficient_table(fit: dict) -> DataFrame:
    """Terms with estimate, standard error, statistic and p-value: one row per term of the formula.

    Estimates are NULL where there are none (an outcome that never varies, a singular design)."""
    return coefficient_rows(fit["fit"], [], fit["terms"], fit["family"])


def information_table(fits: dict[str, dict]) -> DataFrame:
    """Model comparison: parameters, log-likelihood, AICc, difference from the best and weight; one row per model.

    A least-squares model counts its variance as a parameter. AICc is NULL with too few rows for it."""
    each = []
    for name, fit in fits.items():
        k = F.col("k") + F.lit(int(fit["family"] == "gaussian"))
        aicc = F.when(F.col("n") > k + 1, -2 * F.col("loglik") + 2 * k + 2 * k * (k + 1) / (F.col("n") - k - 1))
        each.append(fit["fit"].select(F.lit(name).alias("model"), k.alias("k"), "n", "loglik", aicc.alias("aicc")))
    rows = reduce(DataFrame.unionByName, each)
    best = rows.agg(F.min("aicc").alias("_best"))
    near = attach(rows, best, []).withColumn("delta", F.col("aicc") - F.col("_best"))
    total = near.agg(F.sum(F.exp(-F.col("delta") / 2)).alias("_total"))
    return attach(near, total, []).select("model", "k", "n", "loglik", "aicc", "delta", (F.exp(-F.col("delta") / 2) / F.col("_total")).alias("weight"))


def explained_variance(fitted: DataFrame, eta: str, between: DataFrame, residual: float) -> DataFrame:
    """Marginal and conditional share of variance: fixed part from the spread of the linear predictor, between-study part
    from the one-row table ``between`` (tau2), residual part (pi^2 / 3 for a logit)."""
    spread = fitted.agg(F.var_pop(eta).alias("var_fixed")).crossJoin(F.broadcast(between.select("tau2")))
    total = F.col("var_fixed") + F.col("tau2") + F.lit(residual)
    return spread.select(
        "var_fixed",
        "tau2",
        safe_div("var_fixed", total).alias("r2_marginal"),
        safe_div(F.col("var_fixed") + F.col("tau2"), total).alias("r2_conditional"),
    )


LOGIT_RESIDUAL = math.pi**2 / 3
