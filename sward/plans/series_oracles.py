"""Oracle SQL of the series queries."""

from __future__ import annotations

from sward.plans.sql import SPREADS, sql

_COV = "f1:i f2:i n_total:d chat:d chat_corrected:d sc:d"
_G = "PARTITION BY STUDY_ID, MEASURE, GENUS_SPECIES"
_O = f"{_G} ORDER BY YEAR"
_F = f"{_O} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
_KEY = "STUDY_ID:i MEASURE:s GENUS_SPECIES:s"
_SAMPLES = """
    SELECT STUDY_ID, min(n) AS min_samples, max(n) AS max_samples, min(n) / max(n) AS prop
    FROM (SELECT STUDY_ID, YEAR, count(DISTINCT SAMPLE_DESC) AS n FROM kept_rows GROUP BY ALL) GROUP BY ALL"""


def _first3(c: str) -> str:
    v = f"CASE WHEN rn <= 3 THEN {c} END"
    return f"CASE WHEN count({v}) OVER ({_G}) = 3 THEN avg({v}) OVER ({_G}) END"


_METRICS = f"""
    SELECT *, SUM_VALUE / nullif(max(SUM_VALUE) OVER ({_G}), 0) AS REL_VALUE_TO_MAX,
           SUM_VALUE / first_value(nullif(SUM_VALUE, 0) IGNORE NULLS) OVER ({_F}) AS REL_VALUE_TO_FIRST,
           SUM_VALUE / nullif(first_value(SUM_VALUE) OVER ({_F}), 0) AS REL_VALUE_TO_T0,
           SUM_VALUE / nullif({_first3('SUM_VALUE')}, 0) AS REL_VALUE_TO_T0_T3,
           first_value(REL_RANK_TIMEPOINT) OVER ({_F}) AS REL_RANK_T0,
           nth_value(REL_RANK_TIMEPOINT, 2) OVER ({_F}) AS REL_RANK_T1,
           {_first3('REL_RANK_TIMEPOINT')} AS REL_RANK_MEAN_T0_TO_T3,
           (SUM_VALUE - avg(SUM_VALUE) OVER ({_G})) / nullif(stddev_samp(SUM_VALUE) OVER ({_G}), 0) AS Z_TRANS_VALUE,
           (LOG_SUM_VALUE - avg(LOG_SUM_VALUE) OVER ({_G})) / nullif(stddev_samp(LOG_SUM_VALUE) OVER ({_G}), 0)
             AS Z_TRANS_LOG_VALUE,
           stddev_samp(LOG_SUM_VALUE) OVER ({_G}) / nullif(avg(LOG_SUM_VALUE) OVER ({_G}), 0) AS CV_LOG_VALUE,
           first_value(REL_VALUE_COMM) OVER ({_F}) AS REL_VALUE_COMM_T0,
           {_first3('REL_VALUE_COMM')} AS REL_VALUE_COMM_T0_T3,
           count(*) OVER ({_G}) AS N_YEARS,
           coalesce(sum(CASE WHEN back <= 3 THEN SUM_VALUE END) OVER ({_G}) > 0, false) AS ACTIVE_FINAL_3_YRS,
           sum(SUM_VALUE) OVER (PARTITION BY STUDY_ID, MEASURE) AS WHOLE_SERIES_TOTAL,
           sum(SUM_VALUE) OVER ({_G}) / sum(SUM_VALUE) OVER (PARTITION BY STUDY_ID, MEASURE) AS WHOLE_SERIES_REL_VALUE
    FROM (SELECT *, row_number() OVER ({_O}) AS rn, row_number() OVER ({_G} ORDER BY YEAR DESC) AS back,
                 ln(nullif(SUM_VALUE, 0)) AS LOG_SUM_VALUE FROM cranks)
    JOIN (SELECT STUDY_ID, MEASURE, count(DISTINCT GENUS_SPECIES) AS NUM_SPECIES FROM spanel GROUP BY ALL)
      USING (STUDY_ID, MEASURE)"""
_METRIC_COLS = (
    "SUM_VALUE TOTAL_VALUE REL_VALUE_COMM REL_RANK_ALL REL_RANK_TIMEPOINT LOG_SUM_VALUE REL_VALUE_TO_MAX "
    "REL_VALUE_TO_FIRST REL_VALUE_TO_T0 REL_VALUE_TO_T0_T3 REL_RANK_T0 REL_RANK_T1 REL_RANK_MEAN_T0_TO_T3 Z_TRANS_VALUE "
    "Z_TRANS_LOG_VALUE CV_LOG_VALUE REL_VALUE_COMM_T0 REL_VALUE_COMM_T0_T3 WHOLE_SERIES_TOTAL WHOLE_SERIES_REL_VALUE"
).split()
_TAGS = ("abund", "biomass", "percapita")
_DUO_COLS = (
    "STUDY_ID:i YEAR:i GENUS_SPECIES:s Abundance:d Biomass:d PER_CAPITA:d rel_abund:d rel_biomass:d "
    + " ".join(
        f"{t}_rank:i rel_{t}_rank:d rel_{t}_rank_t0:d rel_{t}_rank_first3:d lag_rel_{t}_rank:d" for t in _TAGS
    )
    + " lost:b present_first3:b"
)

ORACLES = {
    "fixed_location_studies": sql("STUDY_ID:i " + " ".join(f"{c}:d" for c in SPREADS), "SELECT * FROM fixed"),
    "fixed_among_travellers": sql(
        "STUDY_ID:i " + " ".join(f"{c}:d" for c in SPREADS) + " abundance:d n_years:i",
        "SELECT * FROM (SELECT STUDY_ID, " + ", ".join(f"stddev_samp({c[3:]}) AS {c}" for c in SPREADS)
        + """ FROM (
            SELECT STUDY_ID, y, avg(la) AS lat_mean, max(la) AS lat_max, min(la) AS lat_min, avg(lo) AS lon_mean, max(lo) AS lon_max, min(lo) AS lon_min
            FROM (SELECT s_nationkey AS STUDY_ID, year AS y, s_acctbal / 1000 + CASE WHEN s_nationkey % 3 = 0 THEN (year - 1992) * 0.4 ELSE 0 END AS la,
                         l_tax * 10 + CASE WHEN s_nationkey % 5 = 1 THEN (year - 1992) * 0.5 ELSE 0 END AS lo FROM raw_rows) GROUP BY ALL)
          GROUP BY STUDY_ID) JOIN (SELECT s_nationkey AS STUDY_ID, sum(l_quantity) AS abundance, count(DISTINCT year) AS n_years FROM raw_rows GROUP BY ALL) USING (STUDY_ID)
          WHERE """ + " AND ".join(f"{c} < 0.3" for c in SPREADS),
    ),
    "fixed_series_totals": sql(
        "STUDY_ID:i YEAR:i abundance:d biomass:d n:i",
        """SELECT STUDY_ID, YEAR, sum(Abundance) AS abundance, sum(Biomass) AS biomass, count(*) AS n FROM series
           GROUP BY ALL""",
    ),
    "sample_coverage": sql(f"STUDY_ID:i YEAR:i SAMPLE_DESC:s {_COV}", "SELECT * FROM cov_sample"),
    "incidence_coverage": sql(f"STUDY_ID:i YEAR:i {_COV}", "SELECT * FROM cov_year"),
    "coverage_consistency": sql(
        "n_rows:i n_mismatch:i", "SELECT count(*) AS n_rows, 0 AS n_mismatch FROM cov_sample"
    ),
    "coverage_overall": sql(
        "n:i mean:d sd:d",
        """SELECT count(chat_corrected) AS n, avg(chat_corrected) AS mean, stddev_samp(chat_corrected) AS sd
           FROM cov_sample""",
    ),
    "coverage_filtered": sql(
        "STUDY_ID:i YEAR:i SAMPLE_DESC:s GENUS_SPECIES:s MEASURE:s VALUE:d chat_corrected:d min_samples:i",
        """SELECT l.*, k.chat_corrected, s.min_samples FROM long l
           JOIN (SELECT DISTINCT STUDY_ID, YEAR, SAMPLE_DESC, chat_corrected FROM kept) k
             USING (STUDY_ID, YEAR, SAMPLE_DESC) JOIN samples s USING (STUDY_ID)""",
        samples=_SAMPLES,
    ),
    "sample_counts": sql("STUDY_ID:i min_samples:i max_samples:i prop:d", _SAMPLES),
    "kept_ratio": sql(
        "rows_before:i rows_after:i row_ratio:d study_ratio:d",
        """SELECT b.n AS rows_before, a.n AS rows_after, a.n / b.n AS row_ratio, a.s / b.s AS study_ratio
           FROM (SELECT count(*) AS n, count(DISTINCT STUDY_ID) AS s FROM series) b,
                (SELECT count(*) AS n, count(DISTINCT STUDY_ID) AS s FROM kept) a""",
    ),
    "series_completed": sql(f"{_KEY} YEAR:i SUM_VALUE:d", "SELECT * FROM spanel"),
    "community_ranks": sql(
        f"{_KEY} YEAR:i SUM_VALUE:d TOTAL_VALUE:d REL_VALUE_COMM:d ABS_RANK:i REL_RANK_ALL:d REL_RANK_TIMEPOINT:d",
        "SELECT * FROM cranks",
    ),
    "species_panel_metrics": sql(
        f"{_KEY} YEAR:i ABS_RANK:i N_YEARS:i NUM_SPECIES:i ACTIVE_FINAL_3_YRS:b "
        + " ".join(f"{c}:d" for c in _METRIC_COLS),
        _METRICS,
    ),
    "loss_summary": sql(
        f"{_KEY} SUM_VALUE:d REL_RANK_TIMEPOINT:d n_year:i n_zeros:i lost_at_end:i frac_missing_after_t0:d "
        "absent_at_some_point:i",
        "SELECT * FROM loss_rows",
    ),
    "bef_series": sql(
        "STUDY_ID:i YEAR:i z:i s:i b:d n_years:i std_year:i ds:i db:d lr_s:d lr_b:d", "SELECT * FROM bef_series"
    ),
    "biomass_timeseries": sql(
        "STUDY_ID:i series:s YEAR:i z:i s:i b:d n_years:i log_b:d length_label:s",
        """SELECT *, STUDY_ID || '_Biomass' AS series, ln(b + 1) AS log_b, n_years || ' years' AS length_label
           FROM bef_n WHERE n_years > 3""",
    ),
    "log_ratio_change": sql(
        "STUDY_ID:i YEAR:i std_year:i lr_s:d lr_b:d", "SELECT * FROM bef_series WHERE lr_s IS NOT NULL"
    ),
    "biomass_cv": sql(
        "STUDY_ID:i cv_b:d", "SELECT STUDY_ID, stddev_samp(b) / avg(b) AS cv_b FROM bef_series GROUP BY STUDY_ID"
    ),
    "abundance_biomass_ranks": sql(_DUO_COLS, "SELECT * FROM duo_all"),
    "abundance_biomass_ranks_strict": sql(
        "STUDY_ID:i YEAR:i GENUS_SPECIES:s rel_abund_rank_t0:d rel_abund_rank_first3:d lag_rel_abund_rank:d "
        "lag_rel_percapita_rank:d lost:b",
        """SELECT STUDY_ID, YEAR, GENUS_SPECIES, rel_abund_rank_t0,
                  CASE WHEN count(*) OVER (PARTITION BY STUDY_ID, GENUS_SPECIES) >= 3 THEN rel_abund_rank_t0 END
                    AS rel_abund_rank_first3,
                  CASE WHEN rn > 1 THEN rel_abund_rank_t0 END AS lag_rel_abund_rank,
                  CASE WHEN rn > 1 THEN rel_percapita_rank_t0 END AS lag_rel_percapita_rank,
                  CASE WHEN rn > 1 THEN Abundance = 0 AND rel_abund_rank_t0 <> 0 END AS lost
           FROM duo_all""",
    ),
    "abundance_trajectories": sql(
        "MEASURE:s share_facet:s rank_facet:s YEAR_STD:i n:i mean_share:d mean_rank:d",
        """SELECT MEASURE, share_facet, rank_facet, YEAR_STD, count(*) AS n, avg(REL_VALUE_COMM) AS mean_share,
                  avg(REL_RANK_TIMEPOINT) AS mean_rank
           FROM (SELECT *, YEAR - min(YEAR) OVER (PARTITION BY STUDY_ID) + 1 AS YEAR_STD,
                        CASE WHEN REL_VALUE_COMM_T0_T3 <= 0.01 THEN '0 to 0.01' WHEN REL_VALUE_COMM_T0_T3 <= 0.2 THEN
                             '0.01 to 0.2' WHEN REL_VALUE_COMM_T0_T3 <= 0.5 THEN '0.2 to 0.5' ELSE '0.5 to 1' END
                          AS share_facet,
                        CASE WHEN REL_RANK_T0 IS NULL THEN NULL WHEN REL_RANK_T0 <= 0.01 THEN '0 to 0.01'
                             WHEN REL_RANK_T0 <= 0.25 THEN '0.01 to 0.25' WHEN REL_RANK_T0 <= 0.5 THEN '0.25 to 0.5'
                             WHEN REL_RANK_T0 <= 0.75 THEN '0.5 to 0.75' ELSE '0.75 to 1' END AS rank_facet
                 FROM sm WHERE REL_VALUE_COMM_T0_T3 > 0 AND N_YEARS >= 7)
           GROUP BY ALL""",
        sm=_METRICS,
    ),
    "lost_at_end_by_rank": sql(
        "STUDY_ID:i GENUS_SPECIES:s lost_at_end:i rel_abund_rank_t0:d rel_percapita_rank_t0:d",
        """SELECT STUDY_ID, GENUS_SPECIES, CASE WHEN arg_max(Abundance, YEAR) = 0 THEN 1 ELSE 0 END AS lost_at_end,
                  max(rel_abund_rank_t0) AS rel_abund_rank_t0, max(rel_percapita_rank_t0) AS rel_percapita_rank_t0
           FROM duo_all GROUP BY ALL HAVING max(rel_percapita_rank_t0) IS NOT NULL""",
    ),
    "standard_years": sql(
        "STUDY_ID:i YEAR:i std_year:i std_year_1:i",
        """SELECT *, std_year + 1 AS std_year_1 FROM (
             SELECT STUDY_ID, YEAR, YEAR - min(YEAR) OVER (PARTITION BY STUDY_ID) AS std_year
             FROM (SELECT DISTINCT STUDY_ID, YEAR FROM series))""",
    ),
    "studies_with_both_measures": sql(
        "STUDY_ID:i MEASURE:s total:d n:i",
        """SELECT STUDY_ID, MEASURE, sum(v) AS total, count(*) AS n FROM (
             SELECT STUDY_ID, MEASURE, YEAR, GENUS_SPECIES, sum(VALUE) AS v FROM long GROUP BY ALL)
           WHERE STUDY_ID IN (SELECT STUDY_ID FROM long GROUP BY STUDY_ID
                              HAVING count(DISTINCT YEAR) > 3 AND count(DISTINCT MEASURE) = 2) GROUP BY ALL""",
    ),
}
