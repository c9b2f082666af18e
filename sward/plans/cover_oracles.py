"""Oracle SQL of the cover queries."""

from __future__ import annotations

from sward.plans.sql import sql

_ROW = "site_code:s plot:i year:i Taxon:s"
_SP = "site_code:s plot:i Taxon:s"
_PY = "site_code:s plot:i year:i"
_SYS = ("di_class", "di_class2", "rel_class", "rel_class2", "freq_class", "freq_class2")
_NR = "coalesce({c} IN ('Subordinate', 'Dominant'), false)"


def _preds(c: str) -> dict[str, str]:
    nr = _NR.format(c=c)
    p = "local_provenance"
    return {
        "domspp": f"{c} = 'Dominant'",
        "rarespp": f"{c} = 'Rare'",
        "subordspp": f"{c} = 'Subordinate'",
        "non_rare": nr,
        "rare": f"NOT {nr}",
        "rare_int": f"NOT {nr} AND {p} = 'INT'",
        "rare_nat": f"NOT {nr} AND {p} = 'NAT'",
        "non_rare_int": f"{nr} AND {p} = 'INT'",
        "non_rare_nat": f"{nr} AND {p} = 'NAT'",
        "dom_nat": f"{c} = 'Dominant' AND {p} = 'NAT'",
        "dom_int": f"{c} = 'Dominant' AND {p} = 'INT'",
        "sub_nat": f"{c} = 'Subordinate' AND {p} = 'NAT'",
        "sub_int": f"{c} = 'Subordinate' AND {p} = 'INT'",
    }


def _richness(preds: dict[str, str], prefix: str = "sr_") -> str:
    return ", ".join(f"count(DISTINCT CASE WHEN {p} THEN Taxon END) AS {prefix}{k}" for k, p in preds.items())


def _sums(preds: dict[str, str], prefix: str = "cover_") -> str:
    return ", ".join(f"coalesce(sum(CASE WHEN {p} THEN rel_cover END), 0) AS {prefix}{k}" for k, p in preds.items())


def _ints(names, prefix="sr_") -> str:
    return " ".join(f"{prefix}{n}:i" for n in names)


_FOUR = {k: v for k, v in _preds("di_class").items() if k in ("domspp", "rarespp", "subordspp", "non_rare")}
_LIFE = {
    k: f"local_lifespan = '{v}'"
    for k, v in {
        "annual": "ANNUAL",
        "peren": "PERENNIAL",
        "biennial": "BIENNIAL",
        "indeter": "INDETERMINATE",
        "null_lspan": "NULL",
    }.items()
}
_CLASS_COVER = {
    **_preds("di_class"),
    "nat": "local_provenance = 'NAT'",
    "int": "local_provenance = 'INT'",
}
_STRICT = ("domspp", "rarespp", "rare")
_SIX = ("max_cover", "rel_cover", "rel_t0", "rel_freq", "di")
_W_SP = "PARTITION BY site_code, plot, Taxon"
_W_T = f"{_W_SP} ORDER BY year_trt"
_FULL = f"{_W_T} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"

ORACLES = {
    "relative_cover": sql(f"{_ROW} total_cover:d rel_cover:d", "SELECT * FROM live"),
    "relative_cover_all": sql(
        f"{_ROW} live:i total_all:d rel_all:d total_live:d rel_live:d",
        """SELECT *, coalesce(max_cover / nullif(total_all, 0), 0) AS rel_all,
                  coalesce(CASE WHEN live = 1 THEN max_cover ELSE 0 END / nullif(total_live, 0), 0) AS rel_live
           FROM (SELECT *, sum(max_cover) OVER w AS total_all,
                        sum(CASE WHEN live = 1 THEN max_cover ELSE 0 END) OVER w AS total_live
                 FROM cover WINDOW w AS (PARTITION BY site_code, plot, year))""",
    ),
    "cut_classes": sql(
        f"{_SP} " + " ".join(f"{s}:s" for s in _SYS),
        f"SELECT DISTINCT site_code, plot, Taxon, {', '.join(_SYS)} FROM enriched",
    ),
    "six_number_summary": sql(
        "column:s min:d q1:d median:d mean:d q3:d max:d n_null:i",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", min({c}) AS "min", quantile_cont({c}, 0.25) AS q1,
                quantile_cont({c}, 0.5) AS "median", avg({c}) AS mean, quantile_cont({c}, 0.75) AS q3,
                max({c}) AS "max", count(*) - count({c}) AS n_null FROM enriched"""
            for c in _SIX
        ),
    ),
    "bar_stats": sql(
        "trt:s year_trt:i n:i mean:d sd:d se:d",
        """SELECT trt, year_trt, count(*) AS n, avg(rel_cover) AS mean, stddev_samp(rel_cover) AS sd,
                  stddev_samp(rel_cover) / sqrt(count(*)) AS se FROM live GROUP BY ALL""",
    ),
    "mad_filter": sql(
        f"{_ROW} max_cover:d",
        """SELECT * FROM live WHERE abs(max_cover) <= 3 * 1.4826 * (
             SELECT median(abs(max_cover - (SELECT median(max_cover) FROM live))) FROM live)""",
    ),
    "histogram": sql(
        "trt:s bin:i lo:d hi:d n:i",
        """SELECT trt, bin, any_value(lo0 + (hi0 - lo0) / 20 * (bin - 1)) AS lo,
                  any_value(lo0 + (hi0 - lo0) / 20 * bin) AS hi, count(*) AS n
           FROM (SELECT trt, lo0, hi0, least(floor((rel_cover - lo0) / ((hi0 - lo0) / 20)), 19) + 1 AS bin
                 FROM live, (SELECT min(rel_cover) AS lo0, max(rel_cover) AS hi0 FROM live)) GROUP BY trt, bin""",
    ),
    "box_stats": sql(
        "trt:s di_class:s q1:d median:d q3:d lo_whisker:d hi_whisker:d n_out:i",
        """SELECT trt, di_class, q1, med AS "median", q3,
                  min(CASE WHEN rel_cover >= q1 - 1.5 * (q3 - q1) AND rel_cover <= q3 + 1.5 * (q3 - q1)
                      THEN rel_cover END) AS lo_whisker,
                  max(CASE WHEN rel_cover >= q1 - 1.5 * (q3 - q1) AND rel_cover <= q3 + 1.5 * (q3 - q1)
                      THEN rel_cover END) AS hi_whisker,
                  sum(CASE WHEN rel_cover >= q1 - 1.5 * (q3 - q1) AND rel_cover <= q3 + 1.5 * (q3 - q1)
                      THEN 0 ELSE 1 END) AS n_out
           FROM enriched JOIN (SELECT trt, di_class, quantile_cont(rel_cover, 0.25) AS q1,
                  quantile_cont(rel_cover, 0.5) AS med, quantile_cont(rel_cover, 0.75) AS q3
                FROM enriched WHERE di_class IS NOT NULL GROUP BY ALL) USING (trt, di_class)
           GROUP BY trt, di_class, q1, med, q3""",
    ),
    "crosstab_live": sql(
        "Taxon:s n_0:i n_1:i",
        "SELECT Taxon, sum(1 - live) AS n_0, sum(live) AS n_1 FROM records GROUP BY Taxon",
    ),
    "recode_categories": sql(
        "provenance:s introduced_only:s n:i cover:d",
        """SELECT CASE local_provenance WHEN 'NULL' THEN 'UNKNOWN' WHEN 'INT' THEN 'INTRODUCED' WHEN 'NAT' THEN 'NATIVE'
                  ELSE local_provenance END AS provenance,
                  CASE WHEN local_provenance = 'INT' THEN 'INTRODUCED' END AS introduced_only,
                  count(*) AS n, sum(max_cover) AS cover FROM cover GROUP BY 1, 2""",
    ),
    "tolerant_cast": sql(
        "Taxon:s n:i n_number:i cover:d",
        """SELECT Taxon, count(*) AS n, count(v) AS n_number, sum(v) AS cover FROM (
             SELECT Taxon, TRY_CAST(CASE WHEN local_provenance = 'NULL' THEN 'NULL' ELSE CAST(max_cover AS VARCHAR) END
                                    AS DOUBLE) AS v FROM cover) GROUP BY Taxon""",
    ),
    "global_summary": sql(
        "n:i mean:d sd:d", "SELECT count(*) AS n, avg(rel_cover) AS mean, stddev_samp(rel_cover) AS sd FROM live"
    ),
    "panel_size": sql(
        "num_species:i num_sites:i",
        "SELECT count(DISTINCT Taxon) AS num_species, count(DISTINCT site_code) AS num_sites FROM live",
    ),
    "equal_width_bins": sql(
        "bin:i n:i lowest:d highest:d",
        """SELECT bin, count(*) AS n, min(rel_t0) AS lowest, max(rel_t0) AS highest FROM (
             SELECT rel_t0, least(floor((rel_t0 - lo0) / ((hi0 - lo0) / 4)), 3) + 1 AS bin
             FROM enriched, (SELECT min(rel_t0) AS lo0, max(rel_t0) AS hi0 FROM enriched) WHERE rel_t0 IS NOT NULL)
           GROUP BY bin""",
    ),
    "quantile_classes": sql(
        f"{_SP} di:d class:s",
        """SELECT site_code, plot, Taxon, di, CASE WHEN di IS NULL OR nd < 3 THEN NULL WHEN di <= q0 THEN 'Rare'
                  WHEN di <= q1 THEN 'Subordinate' ELSE 'Dominant' END AS class
           FROM enriched JOIN (SELECT site_code, plot, count(DISTINCT di) AS nd, quantile_cont(di, 0.2) AS q0,
                                      quantile_cont(di, 0.8) AS q1 FROM enriched WHERE year_trt = 0 GROUP BY ALL)
             USING (site_code, plot) WHERE year_trt = 0""",
    ),
    "strict_sums": sql(
        f"{_PY} known:d strict:d",
        """SELECT site_code, plot, year, sum(rel_t0) AS known,
                  CASE WHEN count(*) = count(rel_t0) THEN sum(rel_t0) END AS strict FROM enriched GROUP BY ALL""",
    ),
    "complete_panel": sql(f"site_code:s plot:i year_trt:i trt:s Taxon:s rel_cover:d pa:i", "SELECT * FROM panel"),
    "baseline_abundance": sql(
        f"{_ROW} rel_cover:d rel_cover_t0:d rel_cover_t0_or_0:d",
        "SELECT *, rel_t0 AS rel_cover_t0, coalesce(rel_t0, 0) AS rel_cover_t0_or_0 FROM enriched",
    ),
    "site_min_years": sql(
        _ROW,
        """SELECT * FROM live JOIN (SELECT site_code, plot, Taxon FROM live GROUP BY ALL
             HAVING count(DISTINCT year_trt) >= 5 AND sum(max_cover) <> 0) USING (site_code, plot, Taxon)""",
    ),
    "first_differences": sql(
        f"{_PY} {_ints(_FOUR)} {_ints(_FOUR, 'lag_sr_')} {_ints(_FOUR, 'd_sr_')}",
        "SELECT *, "
        + ", ".join(
            f"lag(sr_{k}) OVER w AS lag_sr_{k}, sr_{k} - lag(sr_{k}) OVER w AS d_sr_{k}" for k in _FOUR
        )
        + f" FROM (SELECT site_code, plot, year, {_richness(_FOUR)} FROM enriched GROUP BY ALL)"
        " WINDOW w AS (PARTITION BY site_code, plot ORDER BY year)",
    ),
    "species_cover_change": sql(
        f"{_ROW} rel_cover:d lag_rel_cover:d d_rel_cover:d",
        f"""SELECT *, lag(rel_cover) OVER ({_W_SP} ORDER BY year) AS lag_rel_cover,
                   rel_cover - lag(rel_cover) OVER ({_W_SP} ORDER BY year) AS d_rel_cover FROM live""",
    ),
    "baseline_total_cover": sql(
        f"{_ROW} max_cover:d total_cover_t0:d",
        """SELECT *, coalesce(sum(CASE WHEN year_trt = 0 THEN max_cover END) OVER (PARTITION BY site_code, plot), 0)
                  AS total_cover_t0 FROM live""",
    ),
    "duplicate_audit": sql(
        f"{_SP} n_years:i n_records:i n_subplots:i",
        """SELECT site_code, plot, Taxon, count(DISTINCT year) AS n_years, count(*) AS n_records,
                  count(DISTINCT subplot) AS n_subplots FROM records GROUP BY ALL""",
    ),
    "multi_subplot_plots": sql(
        "site_code:s year:i n_species_plots:i",
        """SELECT site_code, year, count(*) AS n_species_plots FROM (
             SELECT site_code, plot, Taxon, year FROM records GROUP BY ALL HAVING count(DISTINCT subplot) > 1)
           GROUP BY ALL""",
    ),
    "facet_classes": sql(
        "facet:s trt:s n:i mean:d",
        """SELECT CASE WHEN v >= 0 AND v <= 0.25 THEN '0 to .25' WHEN v > 0.25 AND v <= 0.5 THEN '.25 to .5'
                       WHEN v > 0.5 AND v <= 0.75 THEN '.5 to .75' WHEN v > 0.75 AND v <= 1 THEN '.75 to 1' END AS facet,
                  trt, count(*) AS n, avg(rel_cover) AS mean
           FROM (SELECT *, coalesce(rel_t0, 0) AS v FROM enriched) GROUP BY 1, 2""",
    ),
    "latest_rows": sql(
        f"{_ROW} max_cover:d",
        f"SELECT * FROM (SELECT *, max(year) OVER ({_W_SP}) AS last FROM live) WHERE year = last",
    ),
    "quarantine": sql(
        "site_code:s year:i n:i cover:d",
        """SELECT site_code, year, count(*) AS n, sum(max_cover) AS cover FROM cover
           WHERE NOT (site_code = 'S1' AND plot % 7 IN (0, 3) AND year_trt = 0) GROUP BY ALL""",
    ),
    "years_since_start": sql(
        f"{_ROW} std_year:i std_year_1:i",
        f"""SELECT *, year - min(year) OVER ({_W_SP}) AS std_year, year - min(year) OVER ({_W_SP}) + 1 AS std_year_1
            FROM live""",
    ),
    "relative_to_own_series": sql(
        f"{_SP} year_trt:i ratio_max:d ratio_first:d ratio_t0:d ratio_first3:d",
        f"""SELECT *, rel_cover / nullif(max(rel_cover) OVER ({_W_SP}), 0) AS ratio_max,
                   rel_cover / first_value(nullif(rel_cover, 0) IGNORE NULLS) OVER ({_FULL}) AS ratio_first,
                   rel_cover / nullif(first_value(rel_cover) OVER ({_FULL}), 0) AS ratio_t0,
                   CASE WHEN count(*) OVER ({_W_SP}) >= 3 THEN rel_cover / nullif(
                     avg(CASE WHEN rn <= 3 THEN rel_cover END) OVER ({_W_SP}), 0) END AS ratio_first3
            FROM (SELECT *, row_number() OVER ({_W_T}) AS rn FROM panel)""",
    ),
    "z_scores": sql(
        f"{_SP} year_trt:i z:d z_log:d",
        f"""SELECT *, (rel_cover - avg(rel_cover) OVER ({_W_SP})) / nullif(stddev_samp(rel_cover) OVER ({_W_SP}), 0) AS z,
                   (lg - avg(lg) OVER ({_W_SP})) / nullif(stddev_samp(lg) OVER ({_W_SP}), 0) AS z_log
            FROM (SELECT *, ln(nullif(rel_cover, 0)) AS lg FROM panel)""",
    ),
    "last_three_active": sql(
        f"{_SP} active:b",
        """SELECT site_code, plot, Taxon, sum(CASE WHEN back <= 3 THEN rel_cover END) > 0 AS active FROM (
             SELECT *, row_number() OVER (PARTITION BY site_code, plot, Taxon ORDER BY year_trt DESC) AS back FROM panel)
           GROUP BY ALL""",
    ),
    "absence_run_steps": sql(
        f"{_SP} year_trt:i pa:i cons_abs:i",
        f"""SELECT *, CASE WHEN pa = 1 THEN 0 ELSE sum(1 - pa) OVER (
                     PARTITION BY site_code, plot, Taxon, island ORDER BY year_trt) END AS cons_abs
            FROM (SELECT *, sum(pa) OVER ({_W_T}) AS island FROM panel)""",
    ),
    "max_absence_run": sql(
        f"{_SP} cons_abs_max:i",
        f"""SELECT site_code, plot, Taxon, coalesce(max(len), 0) AS cons_abs_max FROM (
              SELECT site_code, plot, Taxon, island, sum(1 - pa) AS len
              FROM (SELECT *, sum(pa) OVER ({_W_T}) AS island FROM panel WHERE year_trt > 0)
              GROUP BY ALL) GROUP BY ALL""",
    ),
    "loss_transitions": sql(
        f"{_SP} year_trt:i lag_value:d lost:i",
        f"""SELECT *, CASE WHEN rel_cover = 0 THEN 1 ELSE 0 END AS lost
            FROM (SELECT *, lag(rel_cover) OVER ({_W_T}) AS lag_value FROM panel) WHERE lag_value <> 0""",
    ),
    "log_ratio_richness": sql(
        "site_code:s plot:i year_trt:i rich:i live_mass:d lr_rich:d lr_live_mass:d",
        """SELECT *, ln(rich + 1) - ln(lag(rich) OVER w + 1) AS lr_rich,
                  ln(live_mass + 1) - ln(lag(live_mass) OVER w + 1) AS lr_live_mass
           FROM comb WINDOW w AS (PARTITION BY site_code, plot ORDER BY year_trt)""",
    ),
    "rel_freq_space": sql(
        "site_code:s Taxon:s n_plots_sp:i n_plots:i rel_freq:d rel_freq_max:d", "SELECT * FROM freq"
    ),
    "dominance_index": sql(
        f"{_SP} rel_t0:d rel_freq:d di:d di_class:s",
        "SELECT DISTINCT site_code, plot, Taxon, rel_t0, rel_freq, di, di_class FROM enriched",
    ),
    "richness_by_class": sql(
        f"{_PY} {_ints(_FOUR)} {_ints(_FOUR, 'na_sr_')}",
        f"SELECT site_code, plot, year, {_richness(_FOUR)}, "
        + ", ".join(
            f"count(DISTINCT CASE WHEN {p} THEN Taxon END) + max(CASE WHEN ({p}) IS NULL THEN 1 ELSE 0 END) AS na_sr_{k}"
            for k, p in _FOUR.items()
        )
        + " FROM enriched GROUP BY ALL",
    ),
    "class_profile": sql(
        f"{_PY} {_ints(_preds('di_class'))} " + " ".join(f"cover_{k}:d" for k in _CLASS_COVER),
        f"SELECT site_code, plot, year, {_richness(_preds('di_class'))}, {_sums(_CLASS_COVER)} FROM enriched GROUP BY ALL",
    ),
    "richness_by_class_provenance": sql(
        f"{_PY} {_ints(_preds('di_class'))}",
        f"SELECT site_code, plot, year, {_richness(_preds('di_class'))} FROM enriched GROUP BY ALL",
    ),
    "richness_class_systems": sql(
        f"{_PY} " + " ".join(_ints(_preds(s), f"sr_{s}_") for s in _SYS),
        "SELECT site_code, plot, year, "
        + ", ".join(_richness(_preds(s), f"sr_{s}_") for s in _SYS)
        + " FROM enriched GROUP BY ALL",
    ),
    "cover_by_class": sql(
        f"{_PY} " + " ".join(f"cover_{k}:d" for k in _CLASS_COVER),
        f"SELECT site_code, plot, year, {_sums(_CLASS_COVER)} FROM enriched GROUP BY ALL",
    ),
    "strict_cover_by_class": sql(
        f"{_PY} " + " ".join(f"cover_{k}:d" for k in _STRICT),
        "SELECT site_code, plot, year, "
        + ", ".join(
            f"CASE WHEN max(CASE WHEN ({_preds('di_class')[k]}) IS NULL THEN 1 ELSE 0 END) = 0 THEN "
            f"coalesce(sum(CASE WHEN {_preds('di_class')[k]} THEN rel_cover END), 0) END AS cover_{k}"
            for k in _STRICT
        )
        + " FROM enriched GROUP BY ALL",
    ),
    "di_over_time": sql(
        f"{_SP} mean_rel:d n_years:i tot_years:i rel_freq_time:d di_time:d",
        """SELECT *, n_years / tot_years AS rel_freq_time, (mean_rel + n_years / tot_years) / 2 AS di_time
           FROM (SELECT site_code, plot, Taxon, avg(rel_cover) AS mean_rel, count(DISTINCT year) AS n_years
                 FROM live GROUP BY ALL)
           JOIN (SELECT site_code, plot, count(DISTINCT year) AS tot_years FROM live GROUP BY ALL)
             USING (site_code, plot)""",
    ),
    "lifespan_richness": sql(
        f"{_PY} {_ints(_LIFE)} d_sr_annual:i d_sr_peren:i cover_annual:d cover_peren:d",
        f"""SELECT *, sr_annual - lag(sr_annual) OVER w AS d_sr_annual, sr_peren - lag(sr_peren) OVER w AS d_sr_peren
            FROM (SELECT site_code, plot, year, {_richness(_LIFE)},
                         {_sums({k: _LIFE[k] for k in ('annual', 'peren')})} FROM live GROUP BY ALL)
            WINDOW w AS (PARTITION BY site_code, plot ORDER BY year)""",
    ),
    "status_counts": sql(
        "status:s non_rare:b n:i class_code:i",
        f"""SELECT coalesce(di_class, 'NA') || '_' || local_provenance AS status, {_NR.format(c='di_class')} AS non_rare,
                   count(*) AS n,
                   max(CASE di_class WHEN 'Rare' THEN 1 WHEN 'Subordinate' THEN 2 WHEN 'Dominant' THEN 3 END)
                     AS class_code FROM enriched GROUP BY 1, 2""",
    ),
    "site_species_metrics": sql(
        "site_code:s Taxon:s mean_pt_abundance:d max_pt_abundance:d n_plots_sp:i n_plots:i rel_freq:d abund_metric:d "
        "abund_metric_count:d",
        "SELECT *, (mean_pt_abundance / 100 + n_plots_sp) / 2 AS abund_metric_count FROM metrics",
    ),
    "dominance_ntile": sql("site_code:s Taxon:s abund_metric:d di_group:i abund_group:i", "SELECT * FROM groups"),
    "wide_ingest_roundtrip": sql(
        f"{_ROW} year_trt:i max_cover:d",
        """SELECT site_code, plot, year, year_trt, Taxon, sum(max_cover) AS max_cover FROM cover GROUP BY ALL
           HAVING sum(max_cover) <> 0""",
    ),
    "richness_compare": sql(
        "year_trt:i site_code:s plot:i trt:s rich:i richness_records:i richness_taxa:i richness_source:i",
        """SELECT c.year_trt, c.site_code, c.plot, r.trt, c.rich, richness_records, richness_taxa,
                  richness_taxa AS richness_source
           FROM comb c JOIN (
             SELECT year_trt, site_code, plot, trt, sum(n_records) AS richness_records,
                    count(DISTINCT Taxon) AS richness_taxa
             FROM cover WHERE live = 1 AND Family <> 'NULL'
               AND site_code IN (SELECT site_code FROM live GROUP BY 1 HAVING count(DISTINCT year_trt) >= 5)
             GROUP BY ALL) r USING (year_trt, site_code, plot)
           WHERE richness_records <> rich OR richness_taxa <> rich OR richness_records <> richness_taxa""",
    ),
    "title_search": sql("TITLE:s", "SELECT DISTINCT p_name AS TITLE FROM part WHERE p_name LIKE '%ring%'"),
    "sample_plots": sql(
        "site_code:s plot:i",
        """SELECT site_code, plot FROM (SELECT DISTINCT site_code, plot FROM cover)
           ORDER BY md5('7|' || site_code || '|' || CAST(plot AS VARCHAR)) LIMIT 10""",
    ),
    "top_species": sql(
        f"{_SP} max_cover:d",
        """SELECT site_code, plot, Taxon, max_cover FROM live WHERE year_trt = 0
           ORDER BY max_cover DESC, plot, Taxon LIMIT 10""",
    ),
}
