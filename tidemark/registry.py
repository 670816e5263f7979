"""All queries of the time-series engine with their SQL."""

from .plans.oracles import SQL
from .plans.queries import QUERIES

__all__ = ["QUERIES", "SQL"]
