"""Named queries over the star-schema tables, and the SQL each one is checked against."""

from tillwise.registry.oracle import oracle_sql
from tillwise.registry.queries import STAR_CONFIG, queries

__all__ = ["STAR_CONFIG", "oracle_sql", "queries"]
