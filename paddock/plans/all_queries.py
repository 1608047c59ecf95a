"""Every registered query; importing the modules fills the registry."""

from paddock.plans import law_queries, learning_queries, race_queries, tree_queries  # noqa: F401
from paddock.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
