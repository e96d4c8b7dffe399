"""Named queries of the core library."""

from pixelweft.plans import color_queries, pixel_queries, table_queries  # noqa: F401
from pixelweft.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
