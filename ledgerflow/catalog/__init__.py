"""Registered queries over the derived market tables, with SQL that checks them."""

from . import asfiled, cross, desk, files, fundamentals, levels, misc, more, pillars, portfolio, prices, research, setups, streams, structure, tables, technical  # noqa: F401  (they register)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
