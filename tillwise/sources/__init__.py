"""Where transaction lines come from, and the shared folder for intermediate tables."""

from tillwise.sources.lines import (
    LINE_COLUMNS,
    LINE_SCHEMA,
    conform,
    lines_of_csv_text,
    read_csv,
    read_parquet,
    read_table,
)
from tillwise.sources.shared import Tables, current, fingerprint, of_application, release, shared_folder, shared_path, stage, staged, written
from tillwise.sources.star import orphans, star_lines, star_paths

__all__ = [
    "LINE_COLUMNS",
    "LINE_SCHEMA",
    "Tables",
    "conform",
    "current",
    "fingerprint",
    "lines_of_csv_text",
    "of_application",
    "orphans",
    "read_csv",
    "read_parquet",
    "read_table",
    "release",
    "shared_folder",
    "shared_path",
    "stage",
    "staged",
    "star_lines",
    "star_paths",
    "written",
]
