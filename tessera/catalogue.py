"""Every query by name, with the SQL it must agree with."""

from tessera.plans import source_queries  # noqa: F401  (adds its own)
from tessera.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
