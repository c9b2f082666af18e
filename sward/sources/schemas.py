"""Explicit schemas of the source tables. Nothing is inferred at scan time."""

from __future__ import annotations

COVER_DDL = (
    "site_name string, site_code string, block int, plot int, subplot string, year int, year_trt int, trt string, "
    "Family string, Taxon string, live int, local_provenance string, local_lifespan string, "
    "functional_group string, max_cover string"
)
PLOT_YEAR_DDL = (
    "site_code string, site_name string, plot int, trt string, year_trt int, rich int, live_mass double, even double"
)
BIOMASS_DDL = "site_code string, plot int, year_trt int, anpp double"
SERIES_DDL = (
    "STUDY_ID int, YEAR int, LATITUDE double, LONGITUDE double, SAMPLE_DESC string, GENUS_SPECIES string, "
    "Abundance double, Biomass double"
)
SERIES_META_DDL = "STUDY_ID int, ABUNDANCE_TYPE string, TITLE string"
