"""All queries of the library but those of its training-data operators."""

from mosaiq.plans import catalog, geography, removal
from mosaiq.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "geography", "removal"]
