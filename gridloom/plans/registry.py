"""Every query of the library and the SQL it is held against."""

from __future__ import annotations

from . import base, pipelines, regression, series, spatial, statistics, storage  # noqa: F401

FLAGSHIP = "w_detrended_mean_series"
QUERIES, ORACLE_SQL = base.QUERIES, base.SQL
