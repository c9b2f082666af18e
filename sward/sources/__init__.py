from sward.sources.files import (  # noqa: F401
    columns_like,
    ingest_wide,
    read_panel_csv,
    read_table,
    scan_csv,
    scan_report,
    write_csv,
    write_table,
)
from sward.sources.versions import read_version, versions, write_version  # noqa: F401
