"""All queries of the library, and SQL for the same rows."""

from . import building, registry  # noqa: F401  building adds its queries to the registry's

QUERIES, ORACLE_SQL = registry.QUERIES, registry.ORACLE_SQL
