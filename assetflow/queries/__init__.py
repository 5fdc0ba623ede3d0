"""All registered queries."""

from assetflow.queries import catalog, groups, lookups, order, rasters, rules, storage, texts, tiles, watching  # noqa: F401
from assetflow.queries.base import REGISTRY

__all__ = ["REGISTRY"]
