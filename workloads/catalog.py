"""All registered queries."""

from workloads import files, logs, preparation, scoring, search, selection  # noqa: F401
from workloads.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
