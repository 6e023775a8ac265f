"""All registered queries, with their SQL twins."""

from tidebar.catalog import (  # noqa: F401
    accuracy_queries, feature_queries, flow_queries, joined_queries, learning_queries, store_queries, stream_queries,
)
from tidebar.catalog.base import ORACLES, QUERIES  # noqa: F401
