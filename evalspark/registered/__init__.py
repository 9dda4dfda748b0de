"""Every query the driver runs, with the SQL another engine repeats it by."""

from __future__ import annotations

from .base import ORACLES, QUERIES
from . import catalogue, clinical, prep, profile, sensitivity, tables, workload  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
