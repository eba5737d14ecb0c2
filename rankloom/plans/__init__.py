"""The registered queries, each with the SQL that it is held against."""

from . import queries_claims, queries_data, queries_rank, queries_text  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
