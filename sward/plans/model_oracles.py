"""Oracle SQL of the model queries. Fits repeat the full Newton step as a chain of tables; models with several terms
eliminate their sums of products pivot by pivot."""

from __future__ import annotations

import math

from sward.plans.effect_oracles import _BEFORE_AFTER, _BIO_DIFF, _EV, _LAGGED
from sward.plans.series_oracles import _METRICS
from sward.plans.sql import SPREADS, sql

_CLASS = """
    SELECT site_code, plot, year_trt, coalesce(sum(CASE WHEN di_class = 'Subordinate' AND local_provenance = 'NAT'
                                                   THEN rel_cover END), 0) AS y
    FROM enriched GROUP BY ALL"""
_BEFY = "SELECT *, ln(b + 1) AS log_b FROM bef_series"
_SLOSS = "SELECT * FROM loss_rows WHERE n_year >= 3"
_OLS_COLS = "n:i b0:d b1:d v00:d v01:d v11:d se_b1:d r2:d"


def _ols(src: str, by: str, y: str, x: str) -> str:
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""
        SELECT *, sqrt(v11) AS se_b1, s2 / n + mx * mx * v11 AS v00, -mx * v11 AS v01 FROM (
          SELECT *, s2 / nullif(sxx, 0) AS v11 FROM (
            SELECT *, my - b1 * mx AS b0, CASE WHEN n > 2 THEN greatest(0, syy - b1 * sxy) / (n - 2) END AS s2,
                   sxy * sxy / nullif(sxx * syy, 0) AS r2 FROM (
              SELECT *, sxy / nullif(sxx, 0) AS b1 FROM (
                SELECT {keys}count(*) AS n, avg({x}) AS mx, avg({y}) AS my, var_pop({x}) * count(*) AS sxx,
                       covar_pop({y}, {x}) * count(*) AS sxy, var_pop({y}) * count(*) AS syy
                FROM ({src}) WHERE {y} IS NOT NULL AND {x} IS NOT NULL {group}))))"""


_SUMS = """
    SELECT {k}, b0, b1, step, sum(s - m * p) AS g0, sum(x * (s - m * p)) AS g1, sum(m * p * (1 - p)) AS h00,
           sum(x * m * p * (1 - p)) AS h01, sum(x * x * m * p * (1 - p)) AS h11, sum(m) AS n,
           sum(s * eta - m * (greatest(eta, 0) + ln(1 + exp(-abs(eta))))) AS loglik
    FROM (SELECT *, 1 / (1 + exp(-eta)) AS p FROM (SELECT c.*, b0, b1, step, b0 + b1 * x AS eta
          FROM {c} c JOIN {prev} USING ({k}))) GROUP BY {k}, b0, b1, step"""


def logit(src: str, by: str, y: str, x: str, w: str = "1.0", rounds: int = 12, tag: str = "") -> dict[str, str]:
    """Tables of a Newton fit per group; the last one is named ``fit<tag>``."""
    k = by or "all_rows"
    keys = by if by else "1 AS all_rows"
    c = f"m_compact{tag}"
    out = {
        c: f"""SELECT {keys}, CAST({x} AS DOUBLE) AS x, CAST(sum({w}) AS DOUBLE) AS m, CAST(sum({w} * {y}) AS DOUBLE) AS s
               FROM ({src}) WHERE {y} IS NOT NULL AND {x} IS NOT NULL GROUP BY {by + ', ' if by else ''}{x}""",
        f"m_it{tag}0": f"""SELECT {k}, ln(sum(s) / (sum(m) - sum(s))) AS b0, 0.0::DOUBLE AS b1, 1.0::DOUBLE AS step
                           FROM {c} GROUP BY {k} HAVING sum(s) > 0 AND sum(s) < sum(m)""",
    }
    ok = "CASE WHEN abs(h00 * h11 - h01 * h01) > 1e-12 THEN h00 * h11 - h01 * h01 END"
    for i in range(rounds):
        out[f"m_it{tag}{i + 1}"] = f"""
            SELECT {k}, b0 + d0 AS b0, b1 + d1 AS b1,
                   CASE WHEN det IS NULL THEN 1.0 ELSE greatest(abs(d0), abs(d1)) END AS step
            FROM (SELECT *, coalesce((h11 * g0 - h01 * g1) / det, 0) AS d0, coalesce((h00 * g1 - h01 * g0) / det, 0) AS d1
                  FROM (SELECT *, {ok} AS det FROM ({_SUMS.format(k=k, c=c, prev=f"m_it{tag}{i}")})))"""
    found = ", ".join(f"CASE WHEN conv THEN {c} END AS {c}" for c in ("b0", "b1", "v00", "v01", "v11", "se_b1", "loglik"))
    out[f"m_last{tag}"] = f"""
        SELECT * EXCLUDE (n), h11 / det AS v00, -h01 / det AS v01, h00 / det AS v11, sqrt(h00 / det) AS se_b1,
               step < 1e-6 AND det IS NOT NULL AS ok
        FROM (SELECT *, {ok} AS det FROM ({_SUMS.format(k=k, c=c, prev=f"m_it{tag}{rounds}")}))"""
    out[f"fit{tag}"] = f"""
        SELECT {k}, n, {found}, conv AS converged, CASE WHEN st = 'fitted' AND NOT conv THEN 'not settled' ELSE st END AS status
        FROM (SELECT *, st = 'fitted' AND coalesce(ok, false) AS conv FROM (
                SELECT {k}, sum(m) AS n,
                       CASE WHEN sum(s) = 0 OR sum(s) = sum(m) THEN 'one outcome' WHEN min(x) = max(x) THEN 'one x'
                            WHEN max(x) FILTER (s > 0) <= min(x) FILTER (s < m)
                              OR max(x) FILTER (s < m) <= min(x) FILTER (s > 0) THEN 'separated' ELSE 'fitted' END AS st
                FROM {c} GROUP BY {k}) LEFT JOIN m_last{tag} USING ({k}))"""
    return out


def glm(src: str, y: str, terms: list[str], family: str = "binomial", rounds: int = 12, tag: str = "") -> dict[str, str]:
    """Tables of a fit over all rows with an intercept and several terms; the last one, ``glm<tag>``, has n, k, b, cov, loglik."""
    k = len(terms) + 1
    rows, at = f"m_rows{tag}", range(1, k + 1)
    mean = "ln(avg(y) / (1 - avg(y)))" if family == "binomial" else "avg(y)"
    eta = " + ".join(f"b[{i}] * x[{i}]" for i in at)
    r, v, value = ("y - p", "p * (1 - p)", "y * eta - greatest(eta, 0) - ln(1 + exp(-abs(eta)))") if family == "binomial" else ("y - eta", "1", "-(y - eta) * (y - eta) / 2")
    sides = [", ".join([*[f"sum({v} * x[{i}] * x[{j}])" for j in at], *["1.0" if i == j else "0.0" for j in at]]) for i in at]
    sums = f"""
        SELECT count(*) AS n, any_value(b) AS b, [{", ".join(f"sum(({r}) * x[{i}])" for i in at)}] AS g, sum({value}) AS value,
               [{", ".join(f"[{side}]" for side in sides)}] AS m
        FROM (SELECT *, 1 / (1 + exp(-eta)) AS p FROM (SELECT x, y, b, {eta} AS eta FROM {rows}, {{prev}}))"""
    for p in at:
        sums = f"""
        SELECT n, b, g, value, list_transform(m, lambda r, i: CASE WHEN i = {p} THEN list_transform(r, lambda e: e / m[{p}][{p}])
                 ELSE list_transform(r, lambda e, j: e - r[{p}] * m[{p}][j] / m[{p}][{p}]) END) AS m
        FROM ({sums})"""
    out = {
        rows: f"SELECT CAST([{', '.join(['1', *terms])}] AS DOUBLE[]) AS x, CAST({y} AS DOUBLE) AS y FROM ({src}) WHERE {' AND '.join(f'({t}) IS NOT NULL' for t in [y, *terms])}",
        f"m_glm{tag}0": f"SELECT [{mean}{', 0.0' * (k - 1)}] AS b FROM {rows}",
    }
    for i in range(rounds):
        step = ", ".join(f"b[{i}] + list_dot_product(m[{i}][{k + 1}:], g)" for i in at)
        out[f"m_glm{tag}{i + 1}"] = f"SELECT [{step}] AS b FROM ({sums.format(prev=f'm_glm{tag}{i}')})"
    scale, loglik = ("1", "value") if family == "binomial" else (f"(-2 * value / (n - {k}))", f"-n / 2.0 * (ln(-2 * value * 2 * pi() / n) + 1)")
    out[f"glm{tag}"] = f"""
        SELECT n, {k} AS k, b, {loglik} AS loglik, [{", ".join(f"{scale} * m[{i}][{k + i}]" for i in at)}] AS v
        FROM ({sums.format(prev=f"m_glm{tag}{rounds}")})"""
    return out


def _tails(z: str) -> str:
    """Both tails of the normal distribution, as a series and a continued fraction."""
    density = f"(exp(-{z} * {z} / 2) * {1 / math.sqrt(2 * math.pi)!r})"
    series = f"list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(0, 60), lambda i: 121.0::DOUBLE - 2 * i)), lambda s, n: 1 + s * {z} * {z} / n)"
    fraction = f"list_reduce(list_prepend({z}, list_transform(range(0, 80), lambda i: 80.0::DOUBLE - i)), lambda s, n: {z} + n / s)"
    return f"CASE WHEN {z} < 3 THEN 1 - 2 * {density} * {z} * {series} ELSE 2 * {density} / {fraction} END"


def _terms(names: list[str], family: str = "binomial", tag: str = "") -> str:
    """Coefficient rows of ``glm<tag>``."""
    names = ["(Intercept)", *names]
    z = "abs(statistic)"
    if family == "gaussian":
        y = "((nu - 0.5) * ln(1 + statistic * statistic / nu))"
        b = "(48 * (nu - 0.5) * (nu - 0.5))"
        z = f"(((((-0.4 * {y} - 3.3) * {y} - 24.0) * {y} - 85.5) / (0.8 * {y} * {y} + 100.0 + {b}) + {y} + 3.0) / {b} + 1.0) * sqrt({y})"
    return f"""
        SELECT term, estimate, se, statistic, {_tails('z')} AS p_value FROM (SELECT *, {z} AS z FROM (
          SELECT *, estimate / se AS statistic FROM (
            SELECT n - k AS nu, unnest({names}) AS term, unnest(b) AS estimate, sqrt(unnest(v)) AS se FROM glm{tag})))"""


def _dummies(also: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Names and SQL of rank, treatment and their products, and of more covariates and their products with treatment."""
    names, texts = ["rel_rank_lag", *also], ["rel_rank_lag", *also]
    for t in ("N", "NP", "NPK"):
        own = f"(CASE trt WHEN '{t}' THEN 1.0 ELSE 0.0 END)"
        names += [f"trt_{t}", f"rel_rank_lag_x_trt_{t}"]
        texts += [own, f"rel_rank_lag * {own}"]
    for c in also:
        for t in ("N", "NP", "NPK"):
            names.append(f"{c}_x_trt_{t}")
            texts.append(f"{c} * (CASE trt WHEN '{t}' THEN 1.0 ELSE 0.0 END)")
    return names, texts


_TERM_COLS = "term:s estimate:d se:d statistic:d p_value:d"
_TREAT, _YEAR = _dummies(), _dummies(("year_trt",))
_PAIR_TERMS = ["lag_rel_abund_rank", "lag_rel_percapita_rank", "lag_rel_abund_rank * lag_rel_percapita_rank"]
_SERIES_TERMS = ["YEAR_STD", "REL_RANK_T0", "YEAR_STD * REL_RANK_T0"]


def _aicc() -> tuple[str, dict[str, str]]:
    tables: dict[str, str] = {}
    models = (("rank", ["rel_rank_lag"]), ("rank + year", ["rel_rank_lag", "year_trt"]), ("rank * year", ["rel_rank_lag", "year_trt", "rel_rank_lag * year_trt"]))
    for tag, (_, terms) in zip("uvw", models, strict=True):
        tables |= glm(_LAGGED, "lost", terms, tag=tag)
    each = " UNION ALL ".join(f"SELECT '{name}' AS model, n, k, loglik FROM glm{tag}" for tag, (name, _) in zip("uvw", models, strict=True))
    return f"""
        SELECT *, exp(-delta / 2) / sum(exp(-delta / 2)) OVER () AS weight FROM (SELECT *, aicc - min(aicc) OVER () AS delta FROM (
          SELECT *, -2 * loglik + 2 * k + 2.0 * k * (k + 1) / (n - k - 1) AS aicc FROM ({each})))""", tables


_FIT_COLS = "n:d b0:d b1:d v00:d v01:d v11:d se_b1:d loglik:d converged:b status:s"


def _pool(src: str) -> str:
    """Random-effects mean of b1 with variance v11."""
    return f"""
        SELECT k, q, tau2, sum(b1 / (v11 + tau2)) / sum(1 / (v11 + tau2)) AS pooled,
               sqrt(1 / sum(1 / (v11 + tau2))) AS se
        FROM (SELECT * FROM {src} WHERE b1 IS NOT NULL AND v11 > 0),
             (SELECT k, q, greatest(0, coalesce((q - (k - 1)) / nullif(sw - sww / sw, 0), 0)) AS tau2 FROM (
                SELECT k, sw, sww, swbb - swb * swb / sw AS q FROM (
                  SELECT count(*) AS k, sum(1 / v11) AS sw, sum(1 / (v11 * v11)) AS sww, sum(b1 / v11) AS swb,
                         sum(b1 * b1 / v11) AS swbb FROM {src} WHERE b1 IS NOT NULL AND v11 > 0)))
        GROUP BY k, q, tau2"""


_PRED = """
    SELECT *, {f}(eta) AS fit, {f}(eta - 1.96 * se) AS lwr, {f}(eta + 1.96 * se) AS upr FROM (
      SELECT *, b0 + b1 * {x} AS eta, sqrt(greatest(0, v00 + 2 * {x} * v01 + {x} * {x} * v11)) AS se
      FROM {src}, (SELECT {lo} + i * {step} AS {x} FROM range({n}) t(i)))"""


def _pred(src, x, lo, hi, n, link) -> str:
    text = _PRED.format(f="F", x=x, lo=float(lo), step=repr((hi - lo) / (n - 1)), n=n, src=src)
    for e in ("eta - 1.96 * se", "eta + 1.96 * se", "eta"):
        text = text.replace(f"F({e})", f"1 / (1 + exp(-({e})))" if link == "logit" else f"({e})")
    return text


_SITE = logit(_LAGGED, "site_code", "lost", "rel_rank_lag")
_ALL = logit(_LAGGED, "", "lost", "rel_rank_lag", tag="a")
_STUDY_OLS = _ols("SELECT * FROM befy", "STUDY_ID", "log_b", "std_year")
_RES = math.pi**2 / 3

_AICC = _aicc()

ORACLES = {
    "fe_trend": sql(
        "n:i n_entities:i slope:d se:d",
        """SELECT n, e AS n_entities, sxy / sxx AS slope, sqrt((syy - sxy / sxx * sxy) / (n - e - 1) / sxx) AS se FROM (
             SELECT count(*) AS n, count(DISTINCT site_code) AS e, sum(dt * dt) AS sxx, sum(dt * dy) AS sxy,
                    sum(dy * dy) AS syy
             FROM (SELECT site_code, year_trt - avg(year_trt) OVER (PARTITION BY site_code) AS dt,
                          y - avg(y) OVER (PARTITION BY site_code) AS dy FROM cls))""",
        cls=_CLASS,
    ),
    "site_slopes": sql(
        "site_code:s n:i intercept:d slope:d",
        """SELECT site_code, n, intercept, (sty - intercept * st) / stt AS slope FROM s,
             (SELECT (sum(sy) - sum(sty * st / stt)) / (sum(n) - sum(st * st / stt)) AS intercept FROM s)""",
        cls=_CLASS,
        s="""SELECT site_code, count(*)::DOUBLE AS n, sum(year_trt)::DOUBLE AS st, sum(year_trt * year_trt)::DOUBLE AS stt,
                    sum(y) AS sy, sum(year_trt * y) AS sty FROM cls GROUP BY site_code""",
    ),
    "ols_by_study": sql(f"STUDY_ID:i {_OLS_COLS}", _STUDY_OLS, befy=_BEFY),
    "ols_overall": sql(_OLS_COLS, _ols("SELECT * FROM enriched", "", "rel_cover", "di")),
    "abundance_biomass_line": sql(
        f"STUDY_ID:i {_OLS_COLS}",
        _ols("SELECT STUDY_ID, ln(Abundance + 1) AS la, ln(Biomass + 1) AS lb FROM duo_all", "STUDY_ID", "lb", "la"),
    ),
    "quadratic_trend": sql(
        "trt:s n:i c0:d c1:d c2:d",
        """SELECT trt, n, my - b1 * mx - b2 * mq AS c0, b1 AS c1, b2 AS c2 FROM (
             SELECT *, (sxy * sqq - sqy * sxq) / (sxx * sqq - sxq * sxq) AS b1,
                    (sqy * sxx - sxy * sxq) / (sxx * sqq - sxq * sxq) AS b2 FROM (
               SELECT trt, count(*) AS n, avg(x) AS mx, avg(x * x) AS mq, avg(diff) AS my, var_pop(x) AS sxx,
                      var_pop(x * x) AS sqq, covar_pop(x, x * x) AS sxq, covar_pop(x, diff) AS sxy,
                      covar_pop(x * x, diff) AS sqy
               FROM (SELECT *, year_trt::DOUBLE AS x FROM d) GROUP BY trt))""",
        d=_BIO_DIFF,
    ),
    "residual_autocorrelation": sql(
        "STUDY_ID:i n:i lag_corr:d",
        """SELECT STUDY_ID, count(*) AS n, covar_pop(res, lr) / nullif(stddev_pop(res) * stddev_pop(lr), 0) AS lag_corr
           FROM (SELECT STUDY_ID, res, lag(res) OVER (PARTITION BY STUDY_ID ORDER BY YEAR) AS lr
                 FROM (SELECT b.STUDY_ID, YEAR, log_b - b0 - b1 * std_year AS res FROM befy b JOIN o USING (STUDY_ID)))
           WHERE lr IS NOT NULL AND res IS NOT NULL GROUP BY STUDY_ID""",
        befy=_BEFY,
        o=_STUDY_OLS,
    ),
    "binned_trend": sql(
        "trt:s bin:i x_lo:d n:i mean:d sd:d se:d",
        """SELECT trt, bin, bin * 2.0 AS x_lo, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd,
                  stddev_samp(v) / sqrt(count(*)) AS se
           FROM (SELECT trt, floor(rich / 2.0) AS bin, log10(live_mass + 1) AS v FROM comb WHERE year_trt <> 0)
           GROUP BY trt, bin""",
    ),
    "binned_trend_limited": sql(
        "trt:s bin:i x_lo:d n:i mean:d sd:d se:d",
        """SELECT trt, bin, bin * 2.0 AS x_lo, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd,
                  stddev_samp(v) / sqrt(count(*)) AS se
           FROM (SELECT trt, floor(rich / 2.0) AS bin, ln(live_mass) AS v FROM comb WHERE year_trt <> 0)
           WHERE v BETWEEN 13 AND 15 GROUP BY trt, bin""",
    ),
    "rank_density": sql(
        "x_bin:i y_bin:i n:i",
        """SELECT floor(rel_abund_rank / 0.1::DOUBLE) AS x_bin, floor(rel_biomass_rank / 0.1::DOUBLE) AS y_bin, count(*) AS n
           FROM duo_all WHERE rel_abund_rank IS NOT NULL AND rel_biomass_rank IS NOT NULL GROUP BY 1, 2""",
    ),
    "loss_by_rank_bin": sql(
        "bin:i trt:s n:i prop_lost:d",
        """SELECT bin, trt, count(*) AS n, avg(lost) AS prop_lost FROM (
             SELECT trt, lost, least(floor((rel_rank_lag - lo0) / ((hi0 - lo0) / 4)), 3) + 1 AS bin
             FROM lg, (SELECT min(rel_rank_lag) AS lo0, max(rel_rank_lag) AS hi0 FROM lg)) GROUP BY bin, trt""",
        lg=_LAGGED,
    ),
    "coefficient_table": sql(_TERM_COLS, _terms(_TREAT[0]), **glm(_LAGGED, "lost", _TREAT[1])),
    "coefficient_table_with_year": sql(_TERM_COLS, _terms(_YEAR[0]), **glm(_LAGGED, "lost", _YEAR[1])),
    "pair_rank_loss": sql(
        _TERM_COLS,
        _terms(["lag_rel_abund_rank", "lag_rel_percapita_rank", "lag_rel_abund_rank_x_lag_rel_percapita_rank"]),
        **glm("SELECT * FROM duo_all WHERE lag_rel_abund_rank <> 0 AND lost IS NOT NULL", "CAST(lost AS INTEGER)", _PAIR_TERMS),
    ),
    "rank_trajectory_model": sql(
        _TERM_COLS,
        _terms(["YEAR_STD", "REL_RANK_T0", "YEAR_STD_x_REL_RANK_T0"], "gaussian"),
        sm=_METRICS,
        **glm(
            """SELECT *, YEAR - min(YEAR) OVER (PARTITION BY STUDY_ID) + 1 AS YEAR_STD
               FROM sm WHERE REL_VALUE_COMM_T0_T3 > 0 AND N_YEARS >= 7""",
            "REL_RANK_TIMEPOINT", _SERIES_TERMS, "gaussian", rounds=3,
        ),
    ),
    "aicc_table": sql("model:s k:i n:i loglik:d aicc:d delta:d weight:d", _AICC[0], **_AICC[1]),
    "logit_by_site": sql(f"site_code:s {_FIT_COLS}", "SELECT * FROM fit", **_SITE),
    "logit_by_study": sql(
        f"STUDY_ID:i MEASURE:s {_FIT_COLS}",
        "SELECT * FROM fit",
        sl=_SLOSS,
        **logit("SELECT * FROM sl", "STUDY_ID, MEASURE", "absent_at_some_point", "REL_RANK_TIMEPOINT"),
    ),
    "pooled_logit": sql(_FIT_COLS, "SELECT * FROM fita", **_ALL),
    "weighted_fraction_logit": sql(
        f"MEASURE:s {_FIT_COLS}",
        "SELECT * FROM fit",
        sl=_SLOSS,
        **logit(
            "SELECT * FROM sl WHERE absent_at_some_point = 1",
            "MEASURE",
            "frac_missing_after_t0",
            "REL_RANK_TIMEPOINT",
            w="n_year",
        ),
    ),
    "hurdle_logit": sql(
        f"MEASURE:s {_FIT_COLS}",
        "SELECT * FROM fit",
        sl=_SLOSS,
        **logit("SELECT * FROM sl", "MEASURE", "absent_at_some_point", "REL_RANK_TIMEPOINT", w="n_year"),
    ),
    "two_stage_effect": sql("k:i q:d tau2:d pooled:d se:d", _pool("(SELECT * FROM fit WHERE converged)"), **_SITE),
    "two_stage_trend": sql("k:i q:d tau2:d pooled:d se:d", _pool("o"), befy=_BEFY, o=_STUDY_OLS),
    "slope_vs_cv": sql(
        "STUDY_ID:i cv_b:d b1:d v11:d shrunken:d weight:d",
        """SELECT c.STUDY_ID, cv_b, b1, v11, tau2 / (tau2 + v11) AS weight,
                  tau2 / (tau2 + v11) * b1 + (1 - tau2 / (tau2 + v11)) * pooled AS shrunken
           FROM (SELECT STUDY_ID, stddev_samp(b) / avg(b) AS cv_b FROM befy GROUP BY STUDY_ID) c
           LEFT JOIN (SELECT * FROM o WHERE b1 IS NOT NULL AND v11 > 0) o2 USING (STUDY_ID), pool2""",
        befy=_BEFY,
        o=_STUDY_OLS,
        pool2=_pool("o"),
    ),
    "prediction_grid": sql(
        "site_code:s rel_rank_lag:d fit:d lwr:d upr:d", _pred("fit", "rel_rank_lag", 0.0, 1.0, 100, "logit"), **_SITE
    ),
    "trend_prediction_grid": sql(
        "STUDY_ID:i std_year:d fit:d lwr:d upr:d",
        _pred("o", "std_year", 0.0, 9.0, 10, "identity"),
        befy=_BEFY,
        o=f"SELECT * FROM ({_STUDY_OLS}) WHERE b1 IS NOT NULL",
    ),
    "site_rank_grid": sql(
        "site_code:s rel_rank:d trt:s",
        """SELECT * FROM (SELECT DISTINCT site_code FROM cover), (SELECT i * 0.25 AS rel_rank FROM range(5) t(i)),
             (SELECT unnest(['Control', 'N', 'NP', 'NPK']) AS trt)""",
    ),
    "adjusted_means": sql(
        "after_first:b n:i raw_mean:d adjusted_mean:d",
        """SELECT after_first, n, my AS raw_mean, my + slope * (gx - mx) AS adjusted_mean
           FROM lev, (SELECT sum(sxy) / sum(sxx) AS slope, sum(mx * n) / sum(n) AS gx FROM lev)""",
        **_EV,
        ba=_BEFORE_AFTER,
        lev="""SELECT after_first, count(*) AS n, avg(ln(live_mass)) AS my, avg(year_trt) AS mx,
                      var_pop(year_trt) * count(*) AS sxx, covar_pop(ln(live_mass), year_trt) * count(*) AS sxy
               FROM ba GROUP BY after_first""",
    ),
    "explained_variance": sql(
        "var_fixed:d tau2:d r2_marginal:d r2_conditional:d",
        f"""SELECT vf AS var_fixed, tau2, vf / (vf + tau2 + {_RES!r}) AS r2_marginal,
                   (vf + tau2) / (vf + tau2 + {_RES!r}) AS r2_conditional
            FROM (SELECT var_pop(b0 + b1 * rel_rank_lag) AS vf FROM ({_LAGGED}), fita), ({_pool('(SELECT * FROM fit WHERE converged)')})""",
        **_SITE,
        **_ALL,
    ),
    "centred_rank": sql(
        "site_code:s plot:i Taxon:s year_trt:i rank_centred:d",
        "SELECT *, rel_rank_lag - avg(rel_rank_lag) OVER () AS rank_centred FROM lg",
        lg=_LAGGED,
    ),
    "location_spread": sql(
        "STUDY_ID:i " + " ".join(f"{c}:d" for c in SPREADS),
        "SELECT STUDY_ID, "
        + ", ".join(f"stddev_samp({c[3:]}) AS {c}" for c in SPREADS)
        + " FROM loc GROUP BY STUDY_ID",
    ),
}
