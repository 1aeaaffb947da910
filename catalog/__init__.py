"""Registered queries on the driver tables, each with equivalent SQL where practical."""
from catalog.registry import ORACLES, QUERIES
from catalog import composed_queries, layout_queries, pixel_queries, planar_queries, region_queries, segment_queries, shape_queries  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
