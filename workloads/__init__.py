"""Queries over the test tables, one or more per operator, with the same result in plain SQL."""

from workloads import changes, compare, jobs, joins, scans, transforms  # noqa: F401
from workloads.base import REGISTRY

__all__ = ["REGISTRY"]
