"""Import every query module so that the registry is complete."""

from reelspark.plans import catalog_queries, flow_queries, frame_queries, gate_queries, motion_queries, music_queries, planning_queries, primitive_queries  # noqa: F401
from reelspark.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
