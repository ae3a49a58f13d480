"""Point-cloud analytics on Spark DataFrames: one row per laser return."""

from pulseframe.session import build_session, cut_lineage, tune

__all__ = ["build_session", "cut_lineage", "tune"]
