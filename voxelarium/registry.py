"""Registered queries and their SQL oracles."""

from __future__ import annotations

from voxelarium.plans import files, formats, operations, rasters, records, surfaces, volumes

QUERIES: dict = {}
ORACLES: dict = {}
for plans in (volumes, surfaces, operations, files, rasters, records, formats):
    QUERIES.update(plans.QUERIES)
    ORACLES.update(plans.ORACLES)
FLAGSHIP = "slice_xy"
