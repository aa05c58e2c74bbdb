"""Every operator as a named query."""

from . import files, relational, scalar, sql, sql_functions  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
