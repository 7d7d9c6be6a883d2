"""Registered queries over the given tables, with the SQL they must agree with."""

from separatrix.plans.registry import QUERIES, Query
from separatrix.plans import (  # noqa: F401  (imported to register)
    preparation,
    text,
    numbers,
    quality,
    learning,
    inspection,
    combined,
    streams,
)

__all__ = ["QUERIES", "Query"]
