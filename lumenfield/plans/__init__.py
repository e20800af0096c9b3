"""Registered queries; importing the package fills the registry."""

from lumenfield.plans import (  # noqa: F401
    analysis_queries,
    bracket_queries,
    compare_queries,
    glare_queries,
    pixel_queries,
    region_queries,
    source_queries,
    stream_queries,
    sun_queries,
)
from lumenfield.plans.registry import ORACLE, QUERIES, build_oracle

build_oracle()

__all__ = ["ORACLE", "QUERIES"]
