"""Catalogue: query name to callable and to the SQL that must give the same rows."""

from __future__ import annotations

from .plans import aggregate_queries, calibration_queries, detection_queries, detector_queries, geometry_queries, grid_queries, matching_queries, source_queries, stream_queries, window_queries  # noqa: F401  each registers its queries
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
