"""All registered queries."""

from linkloom.catalog import browsing, extracting, resolving, standardizing
from linkloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "browsing", "extracting", "resolving", "standardizing"]
