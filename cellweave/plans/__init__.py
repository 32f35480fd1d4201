"""Every registered query of the spatial operators."""

from cellweave.plans import atlas, census, jobs, pooling, spatial  # noqa: F401
from cellweave.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
