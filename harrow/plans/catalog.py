"""All queries."""

from . import health_queries, state_queries, stream_queries, table_queries, tick_queries, web_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
