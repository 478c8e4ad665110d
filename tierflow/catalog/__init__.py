"""The operators applied to the driver's tables, each with the SQL that must agree."""

from tierflow.catalog import bronze, core, governance, load, marts, quality, sources, streams
from tierflow.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
