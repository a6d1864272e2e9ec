from . import clickbench, meta, operators, realtime, stages, surface, tpch  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
