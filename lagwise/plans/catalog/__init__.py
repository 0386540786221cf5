"""All registered queries."""

from lagwise.plans.catalog import (  # noqa: F401
    aggregates,
    cleaning,
    documents,
    joins,
    learning,
    ledgers,
    pipelines,
    reports,
    stores,
    streams,
    windows,
)
from lagwise.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
