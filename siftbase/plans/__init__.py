"""All registered queries."""

from siftbase.plans import guard, knowledge, retrieval, scalars, state  # noqa: F401
from siftbase.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
