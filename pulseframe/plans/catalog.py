"""All query families in one place."""

from pulseframe.plans import queries_labels, queries_rules, queries_select, queries_space, queries_terrain  # noqa: F401
from pulseframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
