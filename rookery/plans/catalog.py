"""Every registered query of the analytics side, with its oracle SQL."""

from __future__ import annotations

from rookery.plans import grades, lake, market, records, slate, solvers, teams, training  # noqa: F401
from rookery.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
