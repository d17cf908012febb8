"""All registered queries and their SQL."""

from . import generated_queries, kernel_queries, run_queries  # noqa: F401
from .queries import QUERIES, SQL, flagship

__all__ = ["QUERIES", "SQL", "flagship"]
