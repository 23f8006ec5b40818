"""Queries of the object-analytics library and their SQL."""

from __future__ import annotations

from lumenframe.plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
