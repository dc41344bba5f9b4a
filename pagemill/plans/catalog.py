"""Importing this module registers every query of the library itself."""

from pagemill.plans import cleaning, geometry, jobs, operations, pdf, speech  # noqa: F401
from pagemill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
