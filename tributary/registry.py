"""All queries of the library by name, with their SQL twins."""

from .plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
