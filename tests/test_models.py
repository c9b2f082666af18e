"""Model operators against direct solutions."""

import math
import random

import numpy as np
import pytest

from sward import operators as op


def logistic(X, y, w=None, rounds=40):
    """Plain Newton fit: coefficients, covariance, log-likelihood."""
    X, y = np.asarray(X, float), np.asarray(y, float)
    w = np.ones(len(y)) if w is None else np.asarray(w, float)
    b = np.zeros(X.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-X @ b))
        H = X.T @ (X * (w * p * (1 - p))[:, None])
        b = b + np.linalg.solve(H, X.T @ (w * (y - p)))
    p = 1 / (1 + np.exp(-X @ b))
    cov = np.linalg.inv(X.T @ (X * (w * p * (1 - p))[:, None]))
    return b, cov, float(np.sum(w * (y * np.log(p) + (1 - y) * np.log(1 - p))))


def loss_rows(seed=1, n=600):
    r = random.Random(seed)
    out = []
    for i in range(n):
        g, x, t = f"g{i % 3}", round(r.random(), 2), r.choice(["Control", "N", "NPK"])
        eta = 0.5 - 2 * x + 0.7 * (t == "N") + 0.9 * x * (t == "NPK")
        out.append((g, x, t, int(r.random() < 1 / (1 + math.exp(-eta)))))
    return out


def test_trend_with_site_effects(rows):
    df = rows("s string, t int, y double", [(s, t, o + 2.0 * t) for s, o in (("a", 0), ("b", 100)) for t in range(4)])
    r = op.fe_trend(df, "y", "t", ["s"]).first()
    assert r.slope == pytest.approx(2.0) and r.n_entities == 2 and r.se == pytest.approx(0.0, abs=1e-6)


def test_common_intercept_slopes(rows):
    df = rows("s string, t int, y double", [("a", t, 5 + 1.0 * t) for t in range(4)] + [("b", t, 5 - 3.0 * t) for t in range(4)])
    got = {r.s: (r.intercept, r.slope) for r in op.site_slopes(df, "y", "t", "s").collect()}
    assert got["a"] == pytest.approx((5.0, 1.0)) and got["b"] == pytest.approx((5.0, -3.0))


def test_quadratic(rows):
    df = rows("g int, x int, y double", [(1, x, 1 + 2 * x + 3.0 * x * x) for x in range(5)] + [(2, 0, 1.0), (2, 1, 2.0)])
    got = {r.g: r for r in op.quad_by(df, ["g"], "y", "x").collect()}
    assert (got[1].c0, got[1].c1, got[1].c2) == pytest.approx((1.0, 2.0, 3.0)) and got[2].c2 is None


def test_quadratic_is_free_of_origin_and_unit(rows):
    years = [(1, 2000.0 + d, 1 + 2.0 * d + 3 * d * d) for d in range(-5, 6)]
    small = [(2, x / 1000, 1 + 2 * x / 1000 + 3 * (x / 1000) ** 2) for x in range(8)]
    got = {r.g: r for r in op.quad_by(rows("g int, x double, y double", years + small), ["g"], "y", "x").collect()}
    assert (got[1].c2, got[1].c1) == pytest.approx((3.0, 2 - 6 * 2000.0), rel=1e-6)
    assert (got[2].c0, got[2].c1, got[2].c2) == pytest.approx((1.0, 2.0, 3.0), rel=1e-6)


def test_steep_curve_settles(rows):
    xs = [i / 1000 for i in range(1000)]
    flip = {0.499: 1, 0.503: 0}
    df = rows("g int, x double, y int", [(1, x, flip.get(x, int(x > 0.5))) for x in xs])
    got = op.logit_by(df, ["g"], "y", "x").first()
    assert got.converged and got.b1 > 100


def test_small_numbers_survive_the_output_form(rows):
    from sward.plans.registry import presented

    got = presented(rows("a double, b double, c double", [(3e-8, 1000000.1234567, -0.0)])).first()
    assert got.a == 3e-8 and got.b == pytest.approx(1000000.12, abs=1e-9) and got.c == 0.0


def test_line_with_covariance(rows):
    r = random.Random(4)
    pts = [(float(x), 1 + 0.5 * x + r.gauss(0, 1)) for x in range(20)]
    got = op.ols_by(rows("x double, y double", pts), [], "y", "x").first()
    X = np.array([[1, x] for x, _ in pts])
    y = np.array([v for _, v in pts])
    b, rss, *_ = np.linalg.lstsq(X, y, rcond=None)
    cov = np.linalg.inv(X.T @ X) * rss[0] / (len(y) - 2)
    assert (got.b0, got.b1) == pytest.approx(tuple(b))
    assert (got.v00, got.v01, got.v11) == pytest.approx((cov[0, 0], cov[0, 1], cov[1, 1]))
    flat = op.ols_by(rows("x double, y double", [(1.0, 2.0), (1.0, 3.0)]), [], "y", "x").first()
    assert flat.b1 is None


def test_logistic_per_group(rows):
    data = loss_rows()
    df = rows("g string, x double, t string, y int", data + [("one", 0.5, "N", 1), ("sep", 0.1, "N", 0), ("sep", 0.9, "N", 1)])
    got = {r.g: r for r in op.logit_by(df, ["g"], "y", "x").collect()}
    assert got["one"].status == "one outcome" and got["sep"].status == "separated" and got["sep"].b1 is None
    for g in ("g0", "g1", "g2"):
        sub = [(x, y) for k, x, _, y in data if k == g]
        b, cov, ll = logistic([[1, x] for x, _ in sub], [y for _, y in sub])
        assert got[g].converged and (got[g].b0, got[g].b1) == pytest.approx(tuple(b), abs=1e-6)
        assert got[g].v11 == pytest.approx(cov[1, 1], rel=1e-5) and got[g].loglik == pytest.approx(ll)


def test_logistic_weighted_fraction(rows):
    data = [(x / 10, (x % 4) / 4, 4) for x in range(1, 10)]
    r = op.logit_by(rows("x double, y double, w int", data), [], "y", "x", w="w").first()
    b, cov, _ = logistic([[1, x] for x, _, _ in data], [y for _, y, _ in data], [w for _, _, w in data])
    assert (r.b0, r.b1) == pytest.approx(tuple(b), abs=1e-6) and r.v11 == pytest.approx(cov[1, 1], rel=1e-5)


def test_pooled_interaction_model(spark, rows):
    data = loss_rows(2)
    df = rows("g string, x double, t string, y int", data)
    wide, terms = op.design(df, "x", "t", ["Control", "N", "NPK"])
    assert terms == ["x", "t_N", "x_x_t_N", "t_NPK", "x_x_t_NPK"]
    got = {r.term: r for r in op.coefficient_table(op.pooled_glm(wide, "y", terms)).collect()}
    X = [[1, x, t == "N", x * (t == "N"), t == "NPK", x * (t == "NPK")] for _, x, t, _ in data]
    b, cov, ll = logistic(X, [y for *_, y in data])
    for i, name in enumerate(["(Intercept)", *terms]):
        assert got[name].estimate == pytest.approx(b[i], abs=1e-8)
        assert got[name].se == pytest.approx(math.sqrt(cov[i, i]), rel=1e-6)
        assert got[name].p_value == pytest.approx(math.erfc(abs(b[i]) / math.sqrt(2 * cov[i, i])), rel=1e-5)


def test_model_comparison(spark, rows):
    data = loss_rows(3)
    df = rows("g string, x double, t string, y int", data)
    wide, terms = op.design(df, "x", "t", ["Control", "N", "NPK"])
    fits = {"x": op.pooled_glm(df, "y", ["x"]), "x * t": op.pooled_glm(wide, "y", terms)}
    got = {r.model: r for r in op.information_table(fits).collect()}
    _, _, ll = logistic([[1, x] for _, x, _, _ in data], [y for *_, y in data])
    assert got["x"].loglik == pytest.approx(ll, rel=1e-6)
    n = len(data)
    assert got["x"].aicc == pytest.approx(-2 * ll + 4 + 2 * 2 * 3 / (n - 3), rel=1e-6)
    assert sum(r.weight for r in got.values()) == pytest.approx(1.0)


def test_constant_outcome_has_no_uncertainty(spark, rows):
    df = rows("x double, y int", [(float(i), 0) for i in range(10)])
    out = op.coefficient_table(op.pooled_glm(df, "y", ["x"])).collect()
    assert len(out) == 2 and all(r.estimate is None and r.p_value is None for r in out)


def test_two_stage(rows):
    b, v = [1.0, 2.0, 4.0], [0.1, 0.2, 0.4]
    df = rows("s int, b1 double, v11 double", [(i, *p) for i, p in enumerate(zip(b, v))])
    r = op.two_stage_effect(df).first()
    w = np.array([1 / x for x in v])
    bb = np.array(b)
    q = float((w * bb**2).sum() - (w * bb).sum() ** 2 / w.sum())
    tau2 = max(0.0, (q - 2) / (w.sum() - (w**2).sum() / w.sum()))
    w2 = 1 / (np.array(v) + tau2)
    assert (r.q, r.tau2, r.pooled) == pytest.approx((q, tau2, float((w2 * bb).sum() / w2.sum())))
    assert r.se == pytest.approx(math.sqrt(1 / w2.sum()))
    shrunk = {x.s: x.shrunken for x in op.shrunken_slopes(df, ["s"]).collect()}
    assert all(min(b[i], r.pooled) - 1e-9 <= shrunk[i] <= max(b[i], r.pooled) + 1e-9 for i in shrunk)


def test_prediction_grid(spark, rows):
    coef = rows("s string, b0 double, b1 double, v00 double, v01 double, v11 double", [("a", 0.0, 2.0, 0.04, 0.0, 0.01)])
    got = sorted((r.x, r.fit, r.lwr, r.upr) for r in op.predict_grid(coef, op.even(spark, "x", 0.0, 1.0, 3), "x").collect())
    assert [round(g[0], 9) for g in got] == [0.0, 0.5, 1.0]
    inv = lambda e: 1 / (1 + math.exp(-e))
    assert got[2][1] == pytest.approx(inv(2.0)) and got[2][2] == pytest.approx(inv(2.0 - 1.96 * math.sqrt(0.05)))


def test_grid_is_a_full_product(spark, rows):
    g = op.grid(rows("s string", [("a",), ("b",)]), op.even(spark, "x", 0.0, 1.0, 4), op.values(spark, "t", ["N", "P"]))
    assert g.count() == 16 and g.distinct().count() == 16


def test_adjusted_means(rows):
    df = rows("g string, x double, y double", [("a", x, 2 * x) for x in (0.0, 1.0, 2.0)] + [("b", x, 2 * x + 5) for x in (4.0, 5.0)])
    got = {r.g: r.adjusted_mean for r in op.adjusted_means(df, "y", "g", "x").collect()}
    assert got["b"] - got["a"] == pytest.approx(5.0)


def test_pooled_straight_line_model(spark, rows):
    r = random.Random(9)
    data = [(t, x, 0.2 + 0.1 * t - 0.5 * x + 0.3 * t * x + r.gauss(0, 0.1)) for t in range(8) for x in (0.1, 0.4, 0.8)]
    wide, terms = op.design(rows("t int, x double, y double", data), "t", also=["x"])
    got = {c.term: c for c in op.coefficient_table(op.pooled_glm(wide, "y", terms, family="gaussian")).collect()}
    X = np.array([[1, t, x, t * x] for t, x, _ in data])
    b, rss, *_ = np.linalg.lstsq(X, np.array([y for *_, y in data]), rcond=None)
    cov = np.linalg.inv(X.T @ X) * rss[0] / (len(data) - 4)
    for i, name in enumerate(["(Intercept)", "t", "x", "t_x_x"]):
        assert got[name].estimate == pytest.approx(b[i], abs=1e-5)
        assert got[name].se == pytest.approx(math.sqrt(cov[i, i]), rel=1e-4)


def test_explained_variance(spark, rows):
    fitted = rows("eta double", [(0.0,), (2.0,)])
    r = op.explained_variance(fitted, "eta", rows("tau2 double", [(0.5,)]), op.LOGIT_RESIDUAL).first()
    total = 1.0 + 0.5 + math.pi**2 / 3
    assert (r.r2_marginal, r.r2_conditional) == pytest.approx((1 / total, 1.5 / total))


def test_residual_autocorrelation(rows):
    r = random.Random(5)
    data = [(1, t, float(t), 2.0 * t + r.gauss(0, 1)) for t in range(12)]
    got = op.residual_autocorrelation(rows("g int, t int, x double, y double", data), ["g"], "t", "y", "x").first()
    x, y = np.array([d[2] for d in data]), np.array([d[3] for d in data])
    b, a = np.polyfit(x, y, 1)
    res = y - a - b * x
    assert got.n == 11 and got.lag_corr == pytest.approx(np.corrcoef(res[1:], res[:-1])[0, 1])
