"""The registered queries of the engine."""

from . import data_plans, keyspace_plans, search_plans, stream_plans, write_plans
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "data_plans", "keyspace_plans", "search_plans", "stream_plans", "write_plans"]
