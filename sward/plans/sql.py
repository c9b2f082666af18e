"""Building blocks of the oracle SQL: named common tables and typed output columns.

The oracles state each result densely and directly (completed panels, plain windows), whatever route the Spark query
takes, so that they check the route as well as the values.
"""

from __future__ import annotations

import re

SPREADS = [f"sd_{a}_{b}" for a in ("lat", "lon") for b in ("mean", "max", "min")]

CTES: dict[str, str] = {
    "raw_rows": """
        SELECT 'S' || CAST(s_nationkey % 5 AS VARCHAR) AS site_code, l_suppkey AS plot,
               CAST(year(l_shipdate) AS INTEGER) AS year, CAST(year(l_shipdate) - 1995 AS INTEGER) AS year_trt,
               CASE l_suppkey % 4 WHEN 0 THEN 'Control' WHEN 1 THEN 'N' WHEN 2 THEN 'NP' ELSE 'NPK' END AS trt,
               CAST(floor(50 / p_size) AS INTEGER) AS tnum, l_linenumber AS subplot,
               CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS live,
               l_quantity, l_extendedprice, l_tax, s_nationkey, s_acctbal
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "records": """
        SELECT site_code, plot, year, year_trt, trt, subplot, 'T' || CAST(tnum AS VARCHAR) AS Taxon,
               CASE WHEN tnum % 4 = 0 THEN 'NULL' ELSE 'F' || CAST(tnum % 4 AS VARCHAR) END AS Family,
               CASE tnum % 3 WHEN 0 THEN 'NAT' WHEN 1 THEN 'INT' ELSE 'NULL' END AS local_provenance,
               CASE tnum % 5 WHEN 0 THEN 'ANNUAL' WHEN 1 THEN 'PERENNIAL' WHEN 2 THEN 'BIENNIAL'
                    WHEN 3 THEN 'INDETERMINATE' ELSE 'NULL' END AS local_lifespan,
               live, l_quantity AS max_cover, l_extendedprice AS mass
        FROM raw_rows""",
    "cover": """
        SELECT site_code, plot, year, year_trt, trt, Taxon, Family, local_provenance, local_lifespan, live,
               sum(max_cover) AS max_cover, sum(mass) AS mass, count(*) AS n_records
        FROM records GROUP BY ALL""",
    "live": """
        SELECT *, sum(max_cover) OVER (PARTITION BY site_code, plot, year) AS total_cover,
               coalesce(max_cover / nullif(sum(max_cover) OVER (PARTITION BY site_code, plot, year), 0), 0)
                 AS rel_cover
        FROM cover WHERE live = 1""",
    "freq": """
        SELECT site_code, Taxon, n_plots_sp, n_plots, n_plots_sp / nullif(n_plots, 0) AS rel_freq,
               n_plots_sp / nullif(max_plot, 0) AS rel_freq_max
        FROM (SELECT site_code, Taxon, count(DISTINCT CASE WHEN year_trt = 0 THEN plot END) AS n_plots_sp
              FROM live GROUP BY ALL)
        JOIN (SELECT site_code, count(DISTINCT CASE WHEN year_trt = 0 THEN plot END) AS n_plots,
                     max(CASE WHEN year_trt = 0 THEN plot END) AS max_plot FROM live GROUP BY ALL) USING (site_code)""",
    "di_rows": """
        SELECT l.*, f.rel_freq, (rel_t0 + rel_freq) / 2 AS di
        FROM (SELECT *, max(CASE WHEN year_trt = 0 THEN rel_cover END)
                          OVER (PARTITION BY site_code, plot, Taxon) AS rel_t0 FROM live) l
        JOIN freq f USING (site_code, Taxon)""",
    "enriched": "SELECT *, {di_class}, {di_class2}, {rel_class}, {rel_class2}, {freq_class}, {freq_class2} FROM di_rows",
    "units": "SELECT DISTINCT site_code, plot, year_trt, trt FROM live",
    "pool": "SELECT DISTINCT site_code, Taxon FROM live",
    "panel": """
        SELECT u.site_code, u.plot, u.year_trt, u.trt, p.Taxon, coalesce(l.rel_cover, 0) AS rel_cover,
               CASE WHEN coalesce(l.rel_cover, 0) > 0 THEN 1 ELSE 0 END AS pa
        FROM units u JOIN pool p USING (site_code)
        LEFT JOIN live l ON l.site_code = u.site_code AND l.plot = u.plot AND l.year_trt = u.year_trt
          AND l.Taxon = p.Taxon""",
    "classes": """
        SELECT DISTINCT site_code, plot, Taxon, di_class, di_class2, rel_class, freq_class, rel_t0 FROM enriched""",
    "lengths": "SELECT site_code, max(year_trt) AS length FROM live GROUP BY ALL",
    "metrics": """
        SELECT b.*, n_plots_sp, n_plots, rel_freq, (mean_pt_abundance / 100 + rel_freq) / 2 AS abund_metric
        FROM (SELECT site_code, Taxon, avg(rel_cover) * 100 AS mean_pt_abundance,
                     max(rel_cover) * 100 AS max_pt_abundance
              FROM live WHERE year_trt = 0 GROUP BY ALL) b JOIN freq USING (site_code, Taxon)""",
    "groups": """
        SELECT *, ntile(3) OVER (PARTITION BY site_code ORDER BY abund_metric, Taxon) AS di_group,
               ntile(3) OVER (PARTITION BY site_code ORDER BY mean_pt_abundance, Taxon) AS abund_group
        FROM metrics""",
    "comb": """
        SELECT site_code, plot, year_trt, trt, sum(mass) AS live_mass, count(DISTINCT Taxon) AS rich
        FROM cover GROUP BY ALL""",
    # --- series -------------------------------------------------------------------------------------------------
    "loc": """
        SELECT s_nationkey AS STUDY_ID, year AS YEAR, avg(s_acctbal / 1000) AS lat_mean, max(s_acctbal / 1000) AS lat_max,
               min(s_acctbal / 1000) AS lat_min, avg(l_tax * 10) AS lon_mean, max(l_tax * 10) AS lon_max,
               min(l_tax * 10) AS lon_min
        FROM raw_rows GROUP BY ALL""",
    "fixed": (
        "SELECT * FROM (SELECT STUDY_ID, "
        + ", ".join(f"stddev_samp({c[3:]}) AS {c}" for c in SPREADS)
        + " FROM loc GROUP BY ALL) WHERE "
        + " AND ".join(f"{c} < 0.3" for c in SPREADS)
    ),
    "all_series": """
        SELECT s_nationkey AS STUDY_ID, year AS YEAR, CAST(plot AS VARCHAR) AS SAMPLE_DESC,
               'T' || CAST(tnum AS VARCHAR) AS GENUS_SPECIES, sum(l_quantity) AS Abundance,
               sum(l_extendedprice) AS Biomass
        FROM raw_rows GROUP BY ALL""",
    "series": "SELECT * FROM all_series WHERE STUDY_ID IN (SELECT STUDY_ID FROM fixed)",
    "meta": """
        SELECT n_nationkey AS STUDY_ID, n_name AS TITLE,
               CASE WHEN n_nationkey % 5 = 1 THEN 'Presence/Absence' WHEN n_nationkey % 5 > 1 THEN 'Count' END
                 AS ABUNDANCE_TYPE
        FROM nation""",
    "counted": """
        SELECT series.*, ABUNDANCE_TYPE FROM series JOIN meta USING (STUDY_ID)
        WHERE ABUNDANCE_TYPE <> 'Presence/Absence' AND ABUNDANCE_TYPE <> '<NA>'""",
    "weighed": """
        SELECT series.*, ABUNDANCE_TYPE FROM series JOIN meta USING (STUDY_ID) WHERE ABUNDANCE_TYPE IS NULL""",
    "cov_sample": "SELECT *, {chat} FROM (SELECT STUDY_ID, YEAR, SAMPLE_DESC, {f} FROM counted WHERE Abundance > 0 GROUP BY ALL)",
    "incidence": """
        SELECT STUDY_ID, YEAR, GENUS_SPECIES, sum(CASE WHEN Biomass = 0 THEN 0 ELSE 1 END) AS Abundance
        FROM weighed GROUP BY ALL""",
    "cov_year": "SELECT *, {chat} FROM (SELECT STUDY_ID, YEAR, {f} FROM incidence GROUP BY ALL)",
    "kept_rows": """
        SELECT c.STUDY_ID, c.YEAR, c.SAMPLE_DESC, GENUS_SPECIES, Abundance, Biomass, chat_corrected
        FROM counted c JOIN cov_sample v USING (STUDY_ID, YEAR, SAMPLE_DESC) WHERE chat_corrected >= 0.8
        UNION ALL
        SELECT w.STUDY_ID, w.YEAR, w.SAMPLE_DESC, GENUS_SPECIES, Abundance, Biomass, chat_corrected
        FROM weighed w JOIN cov_year v USING (STUDY_ID, YEAR) WHERE chat_corrected >= 0.8""",
    "kept": "SELECT * FROM kept_rows WHERE YEAR > 1880",
    "long_rows": """
        SELECT STUDY_ID, YEAR, SAMPLE_DESC, GENUS_SPECIES, 'Abundance' AS MEASURE, Abundance AS VALUE FROM kept
        UNION ALL
        SELECT STUDY_ID, YEAR, SAMPLE_DESC, GENUS_SPECIES, 'Biomass', Biomass FROM kept""",
    "long": """
        SELECT * FROM long_rows JOIN (SELECT STUDY_ID, MEASURE FROM long_rows GROUP BY ALL HAVING sum(VALUE) <> 0)
        USING (STUDY_ID, MEASURE)""",
    "spanel": """
        SELECT u.STUDY_ID, u.MEASURE, u.YEAR, p.GENUS_SPECIES, coalesce(v.SUM_VALUE, 0) AS SUM_VALUE
        FROM (SELECT DISTINCT STUDY_ID, MEASURE, YEAR FROM long) u
        JOIN (SELECT DISTINCT STUDY_ID, MEASURE, GENUS_SPECIES FROM long) p USING (STUDY_ID, MEASURE)
        LEFT JOIN (SELECT STUDY_ID, MEASURE, YEAR, GENUS_SPECIES, sum(VALUE) AS SUM_VALUE FROM long GROUP BY ALL) v
          ON v.STUDY_ID = u.STUDY_ID AND v.MEASURE = u.MEASURE AND v.YEAR = u.YEAR
         AND v.GENUS_SPECIES = p.GENUS_SPECIES""",
    "cranks": """
        SELECT *, {rank_all}, {rank_above} FROM (
          SELECT *, CASE WHEN ABS_RANK > 1 THEN ABS_RANK END AS above FROM (
            SELECT *, sum(SUM_VALUE) OVER (PARTITION BY STUDY_ID, MEASURE, YEAR) AS TOTAL_VALUE,
                   SUM_VALUE / nullif(sum(SUM_VALUE) OVER (PARTITION BY STUDY_ID, MEASURE, YEAR), 0) AS REL_VALUE_COMM,
                   rank() OVER (PARTITION BY STUDY_ID, MEASURE, YEAR ORDER BY SUM_VALUE) AS ABS_RANK
            FROM spanel))""",
    "bef": """
        SELECT STUDY_ID, YEAR, sum(CASE WHEN SUM_VALUE = 0 THEN 1 ELSE 0 END) AS z,
               sum(CASE WHEN SUM_VALUE <> 0 THEN 1 ELSE 0 END) AS s, sum(SUM_VALUE) AS b
        FROM spanel WHERE MEASURE = 'Biomass' GROUP BY ALL""",
    "bef_n": """
        SELECT *, count(*) OVER (PARTITION BY STUDY_ID) AS n_years,
               YEAR - min(YEAR) OVER (PARTITION BY STUDY_ID) AS std_year FROM bef""",
    "bef_series": """
        SELECT *, s - lag(s) OVER w AS ds, b - lag(b) OVER w AS db, ln(s + 1) - ln(lag(s) OVER w + 1) AS lr_s,
               ln(b + 1) - ln(lag(b) OVER w + 1) AS lr_b
        FROM bef_n WHERE n_years >= 3 WINDOW w AS (PARTITION BY STUDY_ID ORDER BY YEAR)""",
    "duo_wide": """
        SELECT STUDY_ID, YEAR, GENUS_SPECIES, max(CASE WHEN MEASURE = 'Abundance' THEN SUM_VALUE END) AS Abundance,
               max(CASE WHEN MEASURE = 'Biomass' THEN SUM_VALUE END) AS Biomass
        FROM spanel WHERE STUDY_ID IN (SELECT STUDY_ID FROM spanel GROUP BY STUDY_ID
                                       HAVING count(DISTINCT MEASURE) = 2 AND count(DISTINCT YEAR) > 3)
        GROUP BY ALL""",
    "duo": "SELECT *, Biomass / nullif(Abundance, 0) AS PER_CAPITA FROM duo_wide",
    "duo_rank0": """
        SELECT *, {raw_ranks} FROM duo""",
    "duo_rank": """
        SELECT *, {shifted} FROM duo_rank0""",
    "duo_rel": """
        SELECT *, Abundance / nullif(max(Abundance) OVER u, 0) AS rel_abund,
               Biomass / nullif(max(Biomass) OVER u, 0) AS rel_biomass, {rel_ranks}
        FROM duo_rank WINDOW u AS (PARTITION BY STUDY_ID, YEAR)""",
    "duo_all": """
        SELECT *, CASE WHEN lag_rel_abund_rank IS NOT NULL THEN Abundance = 0 AND lag_rel_abund_rank <> 0 END AS lost
        FROM (SELECT *, {t0_ranks},
                     sum(CASE WHEN rn <= 3 AND Abundance <> 0 THEN 1 ELSE 0 END)
                       OVER (PARTITION BY STUDY_ID, GENUS_SPECIES) = 3 AS present_first3
              FROM (SELECT *, row_number() OVER (PARTITION BY STUDY_ID, GENUS_SPECIES ORDER BY YEAR) AS rn
                    FROM duo_rel)
              WINDOW g AS (PARTITION BY STUDY_ID, GENUS_SPECIES ORDER BY YEAR),
                     f AS (PARTITION BY STUDY_ID, GENUS_SPECIES ORDER BY YEAR
                           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
                     p AS (PARTITION BY STUDY_ID, GENUS_SPECIES))""",
    "sfirst": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY STUDY_ID, MEASURE, GENUS_SPECIES ORDER BY YEAR) AS rn
                       FROM cranks)""",
    "sloss": """
        SELECT STUDY_ID, MEASURE, GENUS_SPECIES, count(*) + 1 AS n_year,
               sum(CASE WHEN SUM_VALUE = 0 THEN 1 ELSE 0 END) AS n_zeros,
               CASE WHEN arg_max(SUM_VALUE, YEAR) = 0 THEN 1 ELSE 0 END AS lost_at_end
        FROM sfirst WHERE rn > 1 GROUP BY ALL""",
    "loss_rows": """
        SELECT f.*, n_year, n_zeros, lost_at_end, n_zeros / n_year AS frac_missing_after_t0,
               CASE WHEN n_zeros / n_year <> 0 THEN 1 ELSE 0 END AS absent_at_some_point,
               count(*) OVER () * 0 + n_year AS N_YEARS
        FROM sfirst f LEFT JOIN sloss USING (STUDY_ID, MEASURE, GENUS_SPECIES) WHERE rn = 1 AND SUM_VALUE <> 0""",
}


def _cut(col: str, name: str, breaks) -> str:
    labels = ("Rare", "Subordinate", "Dominant")
    whens = " ".join(
        f"WHEN {col} > {lo} AND {col} <= {hi} THEN '{lab}'" for lo, hi, lab in zip(breaks, breaks[1:], labels)
    )
    return f"CASE {whens} END AS {name}"


def _rescale(r: str, part: str, name: str) -> str:
    lo, hi = f"min({r}) OVER ({part})", f"max({r}) OVER ({part})"
    return (
        f"CASE WHEN {r} IS NULL THEN NULL WHEN {hi} = {lo} THEN 0.5 "
        f"ELSE ({r} - {lo}) / CAST({hi} - {lo} AS DOUBLE) END AS {name}"
    )


_MEASURES = {"Abundance": "abund", "Biomass": "biomass", "PER_CAPITA": "percapita"}
_EST = "1 - (f1 / nullif(n_total, 0)) * (((n_total - 1) * f1) / nullif((n_total - 1) * f1 + {extra}, 0))"
_FIRST3 = (
    "CASE WHEN count(CASE WHEN rn <= 3 THEN {c} END) OVER p = 3 "
    "THEN avg(CASE WHEN rn <= 3 THEN {c} END) OVER p END"
)
_PARTS = {
    "di_class": _cut("di", "di_class", (0.0, 0.2, 0.8, 1.0)),
    "di_class2": _cut("di", "di_class2", (0.0, 0.2, 0.7, 1.0)),
    "rel_class": _cut("rel_t0", "rel_class", (0.0, 0.2, 0.8, 1.0)),
    "rel_class2": _cut("rel_t0", "rel_class2", (0.0, 0.4, 0.8, 1.0)),
    "freq_class": _cut("rel_freq", "freq_class", (0.0, 0.2, 0.8, 1.0)),
    "freq_class2": _cut("rel_freq", "freq_class2", (0.0, 0.4, 0.8, 1.0)),
    "f": (
        "CAST(sum(CASE WHEN Abundance = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS f1, "
        "CAST(sum(CASE WHEN Abundance = 2 THEN 1 ELSE 0 END) AS DOUBLE) AS f2, "
        "CAST(sum(Abundance) AS DOUBLE) AS n_total"
    ),
    "chat": (
        f"{_EST.format(extra='2 * f2')} AS chat, "
        f"CASE WHEN f2 > 0 THEN {_EST.format(extra='2 * f2')} ELSE {_EST.format(extra='2')} END AS chat_corrected, "
        "CASE WHEN f1 = 0 THEN 1 ELSE 1 - (f1 / n_total) * (n_total * ((n_total - 1) / n_total * "
        "CASE WHEN f2 > 0 THEN f1 * f1 / (2 * f2) ELSE f1 * (f1 - 1) / 2 END)) / (n_total * ((n_total - 1) / n_total * "
        "CASE WHEN f2 > 0 THEN f1 * f1 / (2 * f2) ELSE f1 * (f1 - 1) / 2 END) + f1) END AS sc"
    ),
    "rank_all": _rescale("ABS_RANK", "PARTITION BY STUDY_ID, MEASURE, YEAR", "REL_RANK_ALL"),
    "rank_above": _rescale("above", "PARTITION BY STUDY_ID, MEASURE, YEAR", "REL_RANK_TIMEPOINT"),
    "raw_ranks": ", ".join(
        f"CASE WHEN Abundance = 0 THEN 0 ELSE rank() OVER (PARTITION BY STUDY_ID, YEAR ORDER BY {c} NULLS LAST) END "
        f"AS raw_{t}"
        for c, t in _MEASURES.items()
    ),
    "shifted": ", ".join(
        f"CASE WHEN raw_{t} = 0 THEN 0 ELSE raw_{t} - min(nullif(raw_{t}, 0)) OVER (PARTITION BY STUDY_ID, YEAR) + 1 "
        f"END AS {t}_rank"
        for t in _MEASURES.values()
    ),
    "rel_ranks": ", ".join(
        f"{t}_rank / nullif(CAST(max({t}_rank) OVER u AS DOUBLE), 0) AS rel_{t}_rank" for t in _MEASURES.values()
    ),
    "t0_ranks": ", ".join(
        f"first_value(rel_{t}_rank) OVER f AS rel_{t}_rank_t0, "
        f"{_FIRST3.format(c=f'rel_{t}_rank')} AS rel_{t}_rank_first3, lag(rel_{t}_rank) OVER g AS lag_rel_{t}_rank"
        for t in _MEASURES.values()
    ),
}


def _body(name: str) -> str:
    text = CTES[name]
    for key in re.findall(r"\{(\w+)\}", text):
        text = text.replace("{" + key + "}", _PARTS[key])
    return text


def _needed(text: str, found: list[str]) -> None:
    for name in CTES:
        if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
            _needed(_body(name), found)
            if name not in found:
                found.append(name)


def sql(cols: str, body: str, **extra: str) -> str:
    """An oracle: the common tables it needs, extra ones of its own, and typed output columns.

    ``cols``: space-separated ``name:type`` with s text, i integer, d number rounded to 9 significant digits, with 12 decimal places at most as in
    the Spark output, b boolean. Extra tables named ``m_...`` are evaluated once.
    """
    found: list[str] = []
    for text in [*extra.values(), body]:
        _needed(text, found)
    # a table may be referred to only by later ones, so keep the definition order
    ordered = [n for n in CTES if n in found]
    with_ = [f"{n} AS ({_body(n)})" for n in ordered] + [
        f"{n} AS {'MATERIALIZED ' if n.startswith('m_') else ''}({t})" for n, t in extra.items()
    ]
    out = []
    for c in cols.split():
        name, kind = c.split(":")
        q = f'"{name}"'
        if kind == "i":
            out.append(f"CAST({q} AS BIGINT) AS {q}")
        elif kind == "d":
            x = f"CAST({q} AS DOUBLE)"
            scale = f"pow(10.0, least(12, 8 - floor(log10(abs({x})))))"
            whole = f"CASE WHEN {x} = 0 THEN 0.0 WHEN isnan({x}) OR isinf({x}) THEN {x} ELSE round_even({x} * {scale} * (1 + 1e-12), 0) / {scale} + 0.0 END"
            out.append(f"{whole} AS {q}")
        elif kind == "s":
            out.append(f"CAST({q} AS VARCHAR) AS {q}")
        else:
            out.append(f"CAST({q} AS BOOLEAN) AS {q}")
    head = f"WITH {', '.join(with_)} " if with_ else ""
    return f"{head}SELECT {', '.join(out)} FROM ({body})"
