"""All queries by name, and the SQL they are held against."""

from . import corpus, flows, orders, requests, support  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
