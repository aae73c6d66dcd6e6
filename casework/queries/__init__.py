"""All registered queries."""

from casework.queries import (  # noqa: F401
    io_queries,
    model_queries,
    report_queries,
    store_queries,
    stream_queries,
    text_queries,
    vector_queries,
)
from casework.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
