"""Oracle SQL of the queries over scans and sinks: the tables as they are, without the way through a file."""

from __future__ import annotations

from sward.plans.sql import sql

_FIELD = """
    SELECT site_code, plot, year, Taxon, live, CASE WHEN Taxon <> 'T7' AND plot % 11 <> 0 THEN max_cover END AS max_cover,
           CASE WHEN Taxon <> 'T7' AND plot % 11 = 0 THEN 'max_cover' ELSE '' END AS unread
    FROM cover"""

ORACLES = {
    "field_scan": sql("site_code:s plot:i year:i Taxon:s live:i max_cover:d unread:s", _FIELD),
    "field_scan_report": sql(
        "n_rows:i n_bad_lines:i column:s n_missing:i n_unread:i",
        f"""SELECT n AS n_rows, 0 AS n_bad_lines, c AS "column", CASE c WHEN 'max_cover' THEN missing ELSE 0 END AS n_missing,
                   CASE c WHEN 'max_cover' THEN unread ELSE 0 END AS n_unread
            FROM (SELECT count(*) AS n, count(*) FILTER (max_cover IS NULL) AS missing, count(*) FILTER (unread <> '') AS unread FROM ({_FIELD})),
                 (SELECT unnest(['site_code', 'plot', 'year', 'Taxon', 'live', 'max_cover']) AS c)""",
    ),
    "csv_roundtrip": sql(
        "site_code:s plot:i year_trt:i trt:s live_mass:d",
        "SELECT site_code, plot, year_trt, trt, CASE WHEN plot % 5 <> 0 THEN live_mass END AS live_mass FROM comb",
    ),
    "saved_table_roundtrip": sql("site_code:s plot:i year:i Taxon:s rel_cover:d", "SELECT * FROM enriched WHERE site_code = 'S1'"),
    "table_versions": sql(
        "version:i site_code:s n:i n_species:i",
        """SELECT version, site_code, count(*) AS n, count(DISTINCT Taxon) AS n_species
           FROM enriched, (VALUES (1), (2)) v(version) WHERE version = 1 OR year_trt > 0 GROUP BY ALL""",
    ),
    "result_versions": sql(
        "version:i trt:s year_trt:i cover:d n:i",
        """SELECT version, trt, year_trt, sum(max_cover) AS cover, count(*) AS n
           FROM enriched, (VALUES (1), (2)) v(version) WHERE version = 1 OR di_class = 'Dominant' GROUP BY ALL""",
    ),
}
