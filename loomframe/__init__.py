"""A PySpark-native analytics engine: frames, expressions, functions, sources and sinks over Spark DataFrames."""

from . import functions
from .catalog import Catalog, Table
from .operators.expr import Expr, col, lit, sql_expr
from .operators.frame import Frame, Grouped
from .operators.window import Window
from .session import Session, execution_config, spark_session

__all__ = ["Catalog", "Expr", "Frame", "Grouped", "Session", "Table", "Window", "col", "execution_config", "functions", "lit", "spark_session", "sql", "sql_expr"]


def sql(query: str, **bindings) -> Frame:
    """A query over the session's tables and the frames given by name."""
    return Session().sql(query, **bindings)
