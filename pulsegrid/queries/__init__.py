"""Registered queries: operators bound to the given tables, each with the SQL of the same result where there is one."""

from __future__ import annotations

from . import aggregates, beats, composites, contracts, joins, rollups, scalars, series, tables, whole
from .registry import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship", "aggregates", "beats", "composites", "contracts", "joins", "rollups", "scalars", "series", "tables", "whole"]
