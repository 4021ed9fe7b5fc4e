"""The queries of `__spark_entry__.py`: each operator on whole test tables, with the SQL that must give the same rows."""

from querybook.base import QUERIES, SQL
from querybook import (charts, cleaning, correlation, distribution, insight, learning, patterns, profiles, sources,
                       tables, validation)

__all__ = ["QUERIES", "SQL", "charts", "cleaning", "correlation", "distribution", "insight", "learning", "patterns",
           "profiles", "sources", "tables", "validation"]
