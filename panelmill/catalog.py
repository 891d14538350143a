"""Registered queries and their oracle SQL."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
