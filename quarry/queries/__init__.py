"""Every operator bound to the driver's tables, each over whole tables, with SQL for the same rows where SQL can express it."""

from quarry.queries import archive, base, estimators, replication, state  # noqa: F401
from quarry.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
