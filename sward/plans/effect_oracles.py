"""Oracle SQL of the effect, event, turnover and modelling-set queries, written on the completed panel."""

from __future__ import annotations

from sward.plans.sql import _rescale, sql

_SP = "site_code:s plot:i Taxon:s"
_AFTER = "SELECT * FROM panel WHERE year_trt > 0"
_YEARS_ABSENT = """
    SELECT site_code, plot, trt, Taxon, length, sum(pa) AS years_present,
           (length - sum(pa)) / nullif(length, 0) AS yrs_absent, any_value(rel_t0) AS pretrt_cover
    FROM after_t0 JOIN lengths USING (site_code) JOIN classes USING (site_code, plot, Taxon)
    WHERE rel_t0 IS NOT NULL AND length > 0 GROUP BY site_code, plot, trt, Taxon, length"""
_PROP = """
    SELECT site_code, plot, trt, Taxon, abund_metric, sum(pa) AS years_present, sum(pa) / length AS prop_years_present,
           1 - sum(pa) / length AS prop_years_absent
    FROM after_t0 JOIN lengths USING (site_code) JOIN metrics USING (site_code, Taxon)
    GROUP BY site_code, plot, trt, Taxon, abund_metric, length HAVING sum(pa) > 0"""
_SITE_PA = """
    SELECT site_code, Taxon, year_trt, trt, max(pa) AS pa FROM after_t0 JOIN metrics USING (site_code, Taxon)
    GROUP BY ALL"""
_SITE_ABS = """
    SELECT site_code, Taxon, trt, sum(pa) AS years_present, 1 - sum(pa) / length AS prop_years_absent
    FROM site_pa JOIN lengths USING (site_code) GROUP BY site_code, Taxon, trt, length"""
_ABS_CTL = """
    SELECT t.site_code, t.Taxon, t.trt, t.years_present, t.prop_years_absent,
           c.prop_years_absent AS prop_years_absent_ctl,
           CASE WHEN c.prop_years_absent = 0 THEN CASE WHEN t.prop_years_absent = 0 THEN 0 ELSE 1 END
                ELSE (t.prop_years_absent - c.prop_years_absent) / c.prop_years_absent END AS prop_years_absent_diff,
           CASE g.di_group WHEN 1 THEN 'rare' WHEN 2 THEN 'intermediate' WHEN 3 THEN 'common' END AS dom_group
    FROM site_abs t JOIN site_abs c USING (site_code, Taxon) JOIN groups g USING (site_code, Taxon)
    WHERE t.trt <> 'Control' AND c.trt = 'Control' AND c.prop_years_absent < 1"""
_TRT_PA = """
    SELECT t.site_code, t.Taxon, t.year_trt, t.trt, t.pa, g.di_group
    FROM site_pa t JOIN site_pa c USING (site_code, Taxon, year_trt) LEFT JOIN groups g USING (site_code, Taxon)
    WHERE t.trt <> 'Control' AND c.trt = 'Control' AND c.pa > 0"""
_LOSSES = """
    SELECT site_code, year_trt, trt, di_group, count(*) FILTER (pa = 0) AS n_loss, count(*) FILTER (pa = 1) AS n_kept,
           count(*) FILTER (pa = 0) / count(*) AS prop_loss
    FROM trt_pa WHERE di_group IS NOT NULL AND year_trt < 11 GROUP BY ALL"""


def _prop_lost(c: str) -> str:
    return f"""
        SELECT year_trt, trt, {c}, avg(1 - pa) AS mean_prop_lost, stddev_samp(1 - pa) AS sd_prop_lost, count(*) AS n,
               stddev_samp(1 - pa) / sqrt(count(*)) AS se_prop_lost
        FROM panel JOIN classes USING (site_code, plot, Taxon) WHERE year_trt > 0 AND {c} IS NOT NULL GROUP BY ALL"""


def _pct(src: str, keys: str, value: str, scale: str = "100") -> str:
    """Percent difference of the means of a treatment from the control's, by keys."""
    return f"""
        SELECT {keys}, t.trt, (t.m - c.m) / nullif(c.m, 0) * {scale} AS diff
        FROM (SELECT {keys}, trt, avg({value}) AS m FROM ({src}) GROUP BY ALL) t
        JOIN (SELECT {keys}, avg({value}) AS m FROM ({src}) WHERE trt = 'Control' GROUP BY ALL) c USING ({keys})
        WHERE t.trt IN ('N', 'NP', 'NPK') AND c.m <> 0"""


_MAX_DIFF = _pct("SELECT * FROM enriched WHERE year_trt <> 0 AND freq_class IS NOT NULL", "site_code, freq_class", "max_cover")
_BIO_DIFF = _pct("SELECT * FROM comb WHERE year_trt <> 0", "site_code, year_trt", "live_mass")
_CORE = """
    SELECT *, CASE WHEN rel_t0 IS NOT NULL THEN freq_class END AS core_class FROM enriched"""
_DOM = "SELECT DISTINCT site_code, plot, Taxon FROM core WHERE core_class = 'Dominant'"
_DOM_LOST = "SELECT site_code, plot, year_trt, Taxon FROM panel JOIN dom USING (site_code, plot, Taxon) WHERE pa = 0"
_FIRST_LOSS = "SELECT site_code, plot, min(year_trt) AS first_time FROM dom_lost GROUP BY ALL"
_BEFORE_AFTER = """
    SELECT u.site_code, u.plot, u.year_trt, u.trt, live_mass, first_time, u.year_trt > first_time AS after_first, n_species
    FROM units u JOIN first_loss USING (site_code, plot) JOIN comb c
      ON c.site_code = u.site_code AND c.plot = u.plot AND c.year_trt = u.year_trt
    JOIN (SELECT site_code, plot, count(DISTINCT Taxon) AS n_species FROM core WHERE core_class IS NOT NULL GROUP BY ALL) n
      ON n.site_code = u.site_code AND n.plot = u.plot"""
_EV = {"core": _CORE, "dom": _DOM, "dom_lost": _DOM_LOST, "first_loss": _FIRST_LOSS}
_MOSAIC = {
    "m_found": """
        SELECT site_code, plot, year, subplot % 3 AS subplot, year_trt, tnum,
               ['Control', 'N', 'K', 'NPK', 'Fence', 'NPK+Fence'][CAST(plot % 6 + 1 AS BIGINT)] AS trt, 'T' || CAST(tnum AS VARCHAR) AS Taxon,
               sum(CASE WHEN (year + plot) % 5 = 0 OR (tnum = 1 + plot % 3 AND (year + plot) % 4 = 0) THEN 0
                        WHEN tnum = 1 + plot % 3 THEN 60 * l_quantity ELSE l_quantity END) AS max_cover
        FROM raw_rows GROUP BY ALL""",
    "m_shares": """
        SELECT *, coalesce(max_cover / nullif(sum(max_cover) OVER (PARTITION BY site_code, plot, subplot, year), 0), 0) AS rel_cover FROM m_found""",
    "m_mosaic": """
        SELECT *, CASE WHEN rel_t0 > 0 AND rel_t0 <= 0.2 THEN 'Rare' WHEN rel_t0 > 0.2 AND rel_t0 <= 0.8 THEN 'Subordinate'
                       WHEN rel_t0 > 0.8 AND rel_t0 <= 1 THEN 'Dominant' END AS rel_class
        FROM (SELECT *, max(rel_cover) FILTER (year_trt = 0) OVER (PARTITION BY site_code, plot, Taxon) AS rel_t0 FROM m_shares)""",
    "visits": "SELECT DISTINCT site_code, plot, year_trt, trt FROM m_mosaic",
    "lead_sp": "SELECT DISTINCT site_code, plot, Taxon FROM m_mosaic WHERE rel_class = 'Dominant'",
    "lead_lost": """
        SELECT v.site_code, v.plot, v.year_trt, d.Taxon FROM visits v JOIN lead_sp d ON v.site_code = d.site_code AND v.plot = d.plot
        WHERE NOT EXISTS (SELECT 1 FROM m_mosaic m WHERE m.site_code = v.site_code AND m.plot = v.plot AND m.year_trt = v.year_trt
                          AND m.Taxon = d.Taxon AND m.max_cover > 0)""",
    "gone_years": """
        SELECT site_code, plot, Taxon, trt, length, years_present, (length - years_present) / nullif(length, 0) AS yrs_absent, pretrt_cover FROM (
          SELECT site_code, plot, Taxon, max(c) FILTER (year_trt = 0) AS pretrt_cover, coalesce(sum(p) FILTER (year_trt > 0), 0) AS years_present
          FROM (SELECT site_code, plot, Taxon, year_trt, max(rel_cover) AS c, avg(CASE WHEN rel_cover > 0 THEN 1.0 ELSE 0.0 END) AS p
                FROM m_mosaic GROUP BY ALL) GROUP BY ALL)
        JOIN (SELECT DISTINCT site_code, plot, trt FROM m_mosaic WHERE year_trt > 0) USING (site_code, plot)
        JOIN (SELECT site_code, max(year_trt) AS length FROM m_mosaic GROUP BY ALL) USING (site_code)
        WHERE pretrt_cover IS NOT NULL AND length > 0""",
}
_LOSS_PLOTS = """
    SELECT site_code, plot, n_dominant, coalesce(n_losses, 0) AS n_losses, coalesce(n_losses, 0) > 0 AS dom_lost_plot
    FROM (SELECT site_code, plot, count(*) AS n_dominant FROM dom GROUP BY ALL)
    LEFT JOIN (SELECT site_code, plot, count(*) AS n_losses FROM dom_lost GROUP BY ALL) USING (site_code, plot)"""


def _turnover(unit: str, ref: str) -> str:
    join = " AND ".join(f"a.{u} = b.{u}" for u in unit.split(", "))
    return f"""
        SELECT {unit}, year, n_now - common AS appear, n_ref - common AS disappear, n_now + n_ref - common AS total
        FROM (SELECT {', '.join('a.' + u for u in unit.split(', '))}, a.year, a.n AS n_now, b.n AS n_ref,
                     len(list_intersect(a.species, b.species)) AS common
              FROM lists a JOIN lists b ON {join} AND b.year = a.{ref})"""


def _lists(unit: str) -> str:
    return f"""
        SELECT *, min(year) OVER (PARTITION BY {unit}) AS first_year,
               lag(year) OVER (PARTITION BY {unit} ORDER BY year) AS prev_year
        FROM (SELECT {unit}, year, list(DISTINCT Taxon) AS species, count(DISTINCT Taxon) AS n FROM live GROUP BY ALL)"""


_RANK0 = f"""
    SELECT site_code, plot, trt, Taxon, {_rescale('rk', 'PARTITION BY site_code, plot, trt', 'rel_rank_year0')}
    FROM (SELECT *, rank() OVER (PARTITION BY site_code, trt, plot ORDER BY rel_cover) AS rk FROM live
          WHERE year_trt = 0)"""
_LOST_END = """
    SELECT p.site_code, p.plot, r.trt, p.Taxon, p.year_trt, rel_rank_year0, 1 - pa AS lost_at_end
    FROM (SELECT *, max(year_trt) OVER (PARTITION BY site_code, plot, Taxon) AS last FROM panel) p
    JOIN rank0 r ON r.site_code = p.site_code AND r.plot = p.plot AND r.Taxon = p.Taxon
    WHERE p.year_trt = last AND p.year_trt > 0"""
_LAGGED = f"""
    SELECT * FROM (
      SELECT site_code, plot, trt, Taxon, year_trt, lag(r) OVER w AS rel_rank_lag,
             CASE WHEN rel_cover = 0 AND lag(r) OVER w <> 0 THEN 1 ELSE 0 END AS lost
      FROM (SELECT *, coalesce(scaled, 0) AS r FROM (
              SELECT *, {_rescale('rk', 'PARTITION BY site_code, plot, trt, year_trt', 'scaled')} FROM (
                SELECT *, CASE WHEN pa = 1 THEN rank() OVER (PARTITION BY site_code, trt, plot, year_trt, pa
                                                             ORDER BY rel_cover) END AS rk FROM panel)))
      WINDOW w AS (PARTITION BY site_code, plot, Taxon ORDER BY year_trt))
    WHERE rel_rank_lag IS NOT NULL AND rel_rank_lag <> 0"""
_BY_PROP = """
    SELECT trt, count(*) FILTER ({f} = 0) AS n0, count(*) FILTER ({f} = 1) AS n1, avg({f}) AS prop FROM {t} GROUP BY trt"""
_U = "PARTITION BY site_code, plot, year_trt"
_ABS_DIFF_COLS = "site_code:s grouping:s grp:i trt:s diff:d"


def _absent_diff(src: str, value: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT site_code, trt, '{g}' AS \"grouping\", {g} AS grp, {value} AS v FROM ({src}) JOIN groups USING (site_code, Taxon)"
        for g in ("di_group", "abund_group")
    )
    return _pct(parts, 'site_code, "grouping", grp', "v", "1")


_A = {"after_t0": _AFTER}
_S = {**_A, "site_pa": _SITE_PA}
ORACLES = {
    "years_absent": sql(
        f"{_SP} trt:s length:i years_present:d yrs_absent:d pretrt_cover:d abund_metric:d",
        "SELECT * FROM yabs JOIN metrics USING (site_code, Taxon)",
        **_A,
        yabs=_YEARS_ABSENT,
    ),
    "prop_years_absent": sql(
        f"{_SP} trt:s years_present:i prop_years_present:d prop_years_absent:d abund_metric:d", _PROP, **_A
    ),
    "prop_years_absent_diff": sql(
        f"{_SP} trt:s prop_years_absent:d prop_years_absent_ctl:d prop_years_absent_diff:d",
        """SELECT *, prop_years_absent - prop_years_absent_ctl AS prop_years_absent_diff FROM prop LEFT JOIN (
             SELECT site_code, Taxon, avg(prop_years_absent) AS prop_years_absent_ctl FROM prop WHERE trt = 'Control'
             GROUP BY ALL) USING (site_code, Taxon) WHERE trt <> 'Control'""",
        **_A,
        prop=_PROP,
    ),
    "absence_vs_control": sql(
        "site_code:s Taxon:s trt:s years_present:i prop_years_absent:d prop_years_absent_ctl:d "
        "prop_years_absent_diff:d dom_group:s",
        _ABS_CTL,
        **_S,
        site_abs=_SITE_ABS,
    ),
    "absence_bar_stats": sql(
        "trt:s dom_group:s n:i mean:d sd:d se:d",
        """SELECT trt, dom_group, count(*) AS n, avg(prop_years_absent_diff) AS mean,
                  stddev_samp(prop_years_absent_diff) AS sd, stddev_samp(prop_years_absent_diff) / sqrt(count(*)) AS se
           FROM abs_ctl GROUP BY ALL""",
        **_S,
        site_abs=_SITE_ABS,
        abs_ctl=_ABS_CTL,
    ),
    "absent_vs_present_control": sql(
        "site_code:s Taxon:s trt:s di_group:i present:i prop_years_absent:d",
        """SELECT site_code, Taxon, trt, di_group, sum(pa) AS present, (length - sum(pa)) / length AS prop_years_absent
           FROM trt_pa JOIN lengths USING (site_code) GROUP BY site_code, Taxon, trt, di_group, length""",
        **_S,
        trt_pa=_TRT_PA,
    ),
    "losses_by_group": sql(
        "site_code:s year_trt:i trt:s di_group:i n_loss:i n_kept:i prop_loss:d", _LOSSES, **_S, trt_pa=_TRT_PA
    ),
    "losses_fixed_length": sql(
        "trt:s di_group:i year_trt:i n:i mean:d sd:d se:d",
        """SELECT trt, di_group, year_trt, count(*) AS n, avg(prop_loss) AS mean, stddev_samp(prop_loss) AS sd,
                  stddev_samp(prop_loss) / sqrt(count(*)) AS se
           FROM loss_rows_g JOIN lengths USING (site_code) WHERE length = 6 GROUP BY ALL""",
        **_S,
        trt_pa=_TRT_PA,
        loss_rows_g=_LOSSES,
    ),
    "final_year_abundance": sql(
        f"{_SP} trt:s years_present:d pretrt_cover:d final_cover:d",
        """SELECT y.*, p.rel_cover AS final_cover FROM yabs y JOIN panel p
             ON p.site_code = y.site_code AND p.plot = y.plot AND p.Taxon = y.Taxon AND p.year_trt = 6""",
        **_A,
        yabs=_YEARS_ABSENT,
    ),
    "prop_lost_by_year": sql(
        "year_trt:i trt:s di_class:s mean_prop_lost:d sd_prop_lost:d n:i se_prop_lost:d", _prop_lost("di_class")
    ),
    "prop_lost_by_abundance_class": sql(
        "year_trt:i trt:s rel_class:s mean_prop_lost:d sd_prop_lost:d n:i se_prop_lost:d", _prop_lost("rel_class")
    ),
    "species_counts_by_year": sql(
        "year_trt:i di_class:s num_taxon:i",
        """SELECT year_trt, di_class, count(*) AS num_taxon FROM panel JOIN classes USING (site_code, plot, Taxon)
           WHERE year_trt > 0 AND di_class IS NOT NULL GROUP BY ALL""",
    ),
    "pct_diff_from_control": sql(
        "site_code:s di_class:s trt:s diff:d",
        _pct(
            """SELECT e.site_code, e.trt, e.di_class, c.rich FROM enriched e JOIN comb c USING (site_code, plot, year_trt)
               WHERE year_trt <> 0 AND di_class IS NOT NULL""",
            "site_code, di_class",
            "rich",
        ),
    ),
    "pct_diff_last_year": sql(
        "site_code:s di_class:s trt:s diff:d",
        _pct(
            """SELECT * FROM (SELECT *, max(year_trt) OVER (PARTITION BY site_code, plot) AS last FROM enriched)
               WHERE year_trt = last AND year_trt <> 0 AND di_class IS NOT NULL""",
            "site_code, di_class",
            "rel_cover",
        ),
    ),
    "pct_diff_without_outliers": sql(
        "site_code:s freq_class:s trt:s diff:d",
        """SELECT * FROM d WHERE abs(diff) <= 5 * 1.4826 * (
             SELECT median(abs(diff - (SELECT median(diff) FROM d))) FROM d)""",
        d=_MAX_DIFF,
    ),
    "pct_diff_box": sql(
        "trt:s freq_class:s q1:d median:d q3:d lo_whisker:d hi_whisker:d n_out:i",
        """SELECT trt, freq_class, q1, med AS "median", q3,
                  min(diff) FILTER (diff BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS lo_whisker,
                  max(diff) FILTER (diff BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS hi_whisker,
                  count(*) FILTER (NOT diff BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_out
           FROM d JOIN (SELECT trt, freq_class, quantile_cont(diff, 0.25) AS q1, quantile_cont(diff, 0.5) AS med,
                               quantile_cont(diff, 0.75) AS q3 FROM d GROUP BY ALL) USING (trt, freq_class)
           GROUP BY trt, freq_class, q1, med, q3""",
        d=_MAX_DIFF,
    ),
    "biomass_diff_by_year": sql("site_code:s year_trt:i trt:s diff:d", _BIO_DIFF),
    "biomass_diff_bar_stats": sql(
        "year_trt:i trt:s n:i mean:d sd:d se:d",
        """SELECT year_trt, trt, count(*) AS n, avg(diff) AS mean, stddev_samp(diff) AS sd,
                  stddev_samp(diff) / sqrt(count(*)) AS se FROM d GROUP BY ALL""",
        d=_BIO_DIFF,
    ),
    "absent_years_diff_by_group": sql(
        _ABS_DIFF_COLS, _absent_diff("SELECT * FROM yabs WHERE length > 2", "yrs_absent / length"), **_A, yabs=_YEARS_ABSENT
    ),
    "absence_run_diff_by_group": sql(
        _ABS_DIFF_COLS,
        _absent_diff("SELECT * FROM runs", "run_max"),
        **_A,
        runs="""SELECT site_code, plot, trt, Taxon, max(len) AS run_max FROM (
                  SELECT site_code, plot, trt, Taxon, island, sum(1 - pa) AS len FROM (
                    SELECT *, sum(pa) OVER (PARTITION BY site_code, plot, Taxon ORDER BY year_trt) AS island FROM after_t0)
                  GROUP BY ALL) GROUP BY ALL""",
    ),
    "plot_year_biomass_richness": sql(
        "site_code:s plot:i year_trt:i trt:s rich:i live_mass:d log_rich:d log_mass:d",
        """SELECT *, log10(rich + 1) AS log_rich, log10(live_mass + 1) AS log_mass FROM comb WHERE year_trt <> 0""",
    ),
    "biomass_richness_means": sql(
        "site_code:s year_trt:i trt:s mean_rich:d mean_mass:d min_rich:i max_rich:i n:i",
        """SELECT site_code, year_trt, trt, avg(rich) AS mean_rich, avg(live_mass) AS mean_mass, min(rich) AS min_rich,
                  max(rich) AS max_rich, count(*) AS n FROM comb WHERE year_trt <> 0 GROUP BY ALL""",
    ),
    "dominant_loss_events": sql("site_code:s plot:i year_trt:i Taxon:s", "SELECT * FROM dom_lost", **_EV),
    "dominant_loss_plots": sql(
        "site_code:s plot:i n_dominant:i n_losses:i dom_lost_plot:b",
        _LOSS_PLOTS,
        **_EV,
    ),
    "dominant_loss_events_by_abundance": sql("site_code:s plot:i year_trt:i Taxon:s", "SELECT * FROM lead_lost", **_MOSAIC),
    "dominant_loss_plots_by_abundance": sql(
        "site_code:s plot:i n_dominant:i n_losses:i dom_lost_plot:b",
        """SELECT site_code, plot, n_dominant, coalesce(n_losses, 0) AS n_losses, coalesce(n_losses, 0) > 0 AS dom_lost_plot
           FROM (SELECT site_code, plot, count(*) AS n_dominant FROM lead_sp GROUP BY ALL)
           LEFT JOIN (SELECT site_code, plot, count(*) AS n_losses FROM lead_lost GROUP BY ALL) USING (site_code, plot)""",
        **_MOSAIC,
    ),
    "before_after_loss_by_abundance": sql(
        "site_code:s plot:i year_trt:i trt:s live_mass:d first_time:i after_first:b n_species:i",
        """SELECT v.*, live_mass, first_time, v.year_trt > first_time AS after_first, n_species
           FROM visits v JOIN (SELECT site_code, plot, min(year_trt) AS first_time FROM lead_lost GROUP BY ALL) USING (site_code, plot)
           JOIN (SELECT site_code, plot, year_trt, sum(max_cover) AS live_mass FROM m_mosaic GROUP BY ALL) USING (site_code, plot, year_trt)
           JOIN (SELECT site_code, plot, count(DISTINCT Taxon) AS n_species FROM m_mosaic WHERE rel_class IS NOT NULL GROUP BY ALL) USING (site_code, plot)""",
        **_MOSAIC,
    ),
    "years_absent_subplots": sql(f"{_SP} trt:s length:i years_present:d yrs_absent:d pretrt_cover:d", "SELECT * FROM gone_years", **_MOSAIC),
    "lagged_loss_set_subplots": sql(
        f"{_SP} trt:s year_trt:i rel_rank_lag:d lost:i",
        f"""SELECT r.site_code, r.plot, r.trt, r.Taxon, following AS year_trt, scaled AS rel_rank_lag,
                   CASE WHEN EXISTS (SELECT 1 FROM m_mosaic m WHERE m.site_code = r.site_code AND m.plot = r.plot AND m.Taxon = r.Taxon
                                     AND m.year_trt = following AND m.rel_cover > 0) THEN 0 ELSE 1 END AS lost
            FROM (SELECT *, {_rescale('rk', 'PARTITION BY site_code, plot, trt, year_trt', 'scaled')} FROM (
                    SELECT *, rank() OVER (PARTITION BY site_code, trt, plot, year_trt ORDER BY rel_cover) AS rk FROM (
                      SELECT site_code, plot, trt, Taxon, year_trt, avg(rel_cover) AS rel_cover FROM m_mosaic GROUP BY ALL) WHERE rel_cover > 0)) r
            JOIN (SELECT site_code, plot, year_trt, lead(year_trt) OVER (PARTITION BY site_code, plot ORDER BY year_trt) AS following FROM visits) n
              ON n.site_code = r.site_code AND n.plot = r.plot AND n.year_trt = r.year_trt
            WHERE following IS NOT NULL AND scaled <> 0""",
        **_MOSAIC,
    ),
    "absence_ratio_fenced": sql(
        "site_code:s rel_class:s trt:s absent:d absent_ctl:d absent_diff:d",
        """WITH means AS (
             SELECT site_code, rel_class, trt, avg(yrs_absent) AS absent FROM gone_years
             JOIN (SELECT DISTINCT site_code, plot, Taxon, rel_class FROM m_mosaic WHERE rel_class IS NOT NULL) USING (site_code, plot, Taxon) GROUP BY ALL)
           SELECT m.*, c.absent AS absent_ctl, (m.absent - c.absent) / c.absent AS absent_diff
           FROM means m JOIN means c ON m.site_code = c.site_code AND m.rel_class = c.rel_class AND c.trt = 'Control'
           WHERE m.trt IN ('NPK', 'Fence', 'NPK+Fence') AND c.absent <> 0""",
        **_MOSAIC,
    ),
    "first_dominant_loss": sql("site_code:s plot:i first_time:i", "SELECT * FROM first_loss", **_EV),
    "before_after_loss": sql(
        "site_code:s plot:i year_trt:i trt:s live_mass:d first_time:i after_first:b n_species:i", _BEFORE_AFTER, **_EV
    ),
    "biomass_by_loss_flag": sql(
        "after_first:b sum_log_mass:d n_rows:i",
        """SELECT after_first, sum(n_species * ln(live_mass)) AS sum_log_mass, sum(n_species) AS n_rows FROM ba
           GROUP BY after_first""",
        **_EV,
        ba=_BEFORE_AFTER,
    ),
    "turnover_first_year": sql(
        "site_code:s plot:i year:i appear:i disappear:i total:i",
        f"SELECT * FROM ({_turnover('site_code, plot', 'first_year')}) t WHERE year > ("
        "SELECT min(year) FROM live l WHERE l.plot = t.plot AND l.site_code = t.site_code)",
        lists=_lists("site_code, plot"),
    ),
    "turnover_previous_year": sql(
        "site_code:s plot:i year:i appear:i disappear:i total:i",
        _turnover("site_code, plot", "prev_year"),
        lists=_lists("site_code, plot"),
    ),
    "turnover_by_site": sql(
        "site_code:s year:i appear:i disappear:i total:i",
        f"SELECT * FROM ({_turnover('site_code', 'first_year')}) t WHERE year > ("
        "SELECT min(year) FROM live l WHERE l.site_code = t.site_code)",
        lists=_lists("site_code"),
    ),
    "baseline_rank": sql(f"{_SP} trt:s rel_rank_year0:d", _RANK0),
    "lost_at_end_set": sql(
        f"{_SP} trt:s year_trt:i rel_rank_year0:d lost_at_end:i", _LOST_END, rank0=_RANK0
    ),
    "lagged_loss_set": sql(f"{_SP} trt:s year_trt:i rel_rank_lag:d lost:i", _LAGGED),
    "prop_lost_by_treatment": sql(
        "trt:s n0:i n1:i prop:d", _BY_PROP.format(f="lost_at_end", t="le"), rank0=_RANK0, le=_LOST_END
    ),
    "prop_lagged_lost_by_treatment": sql(
        "trt:s n0:i n1:i prop:d", _BY_PROP.format(f="lost", t="lg"), lg=_LAGGED
    ),
    "rank_readings": sql(
        "site_code:s plot:i year_trt:i Taxon:s rank_rank:i rel_rank:d rank_null_min:i rel_null_min:d rank_skip:i "
        "rel_skip:d rank_shift:i rel_shift:d",
        f"""SELECT *, rk AS rank_rank, rk AS rank_null_min, {_rescale('rk', _U, 'rel_rank')},
                   {_rescale('above', _U, 'rel_null_min')}, rks AS rank_skip, coalesce(rel_skip0, 0) AS rel_skip,
                   shifted AS rank_shift, shifted / nullif(CAST(max(shifted) OVER ({_U}) AS DOUBLE), 0) AS rel_shift
            FROM (SELECT *, {_rescale('rks', _U, 'rel_skip0')},
                         CASE WHEN pa = 0 THEN 0 ELSE rk - min(CASE WHEN pa = 1 THEN rk END) OVER ({_U}) + 1 END AS shifted
                  FROM (SELECT *, CASE WHEN rk > 1 THEN rk END AS above FROM (
                          SELECT *, rank() OVER ({_U} ORDER BY rel_cover) AS rk,
                                 CASE WHEN pa = 1 THEN rank() OVER (PARTITION BY site_code, plot, year_trt, pa
                                                                    ORDER BY rel_cover) END AS rks
                          FROM panel)))""",
    ),
}
