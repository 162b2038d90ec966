"""All queries over the test tables; importing the modules registers them."""

from condense.plans import check_queries, day_queries, frame_queries, motion_queries, registry_queries, stream_queries  # noqa: F401
from condense.plans.bound import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
