"""All registered queries."""

from __future__ import annotations

from gaugeworks.plans import numbers, operations, profiles, stored, texts  # noqa: F401
from gaugeworks.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
