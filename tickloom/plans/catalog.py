"""All registered market queries."""

from __future__ import annotations

from . import files, flow, history, market, microstructure, models, performance, ranking, regime, research, signals, tables, trend  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
