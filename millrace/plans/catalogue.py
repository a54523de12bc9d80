"""All registered queries: importing this module imports every module that registers some."""

from ..operators import aggregates, artifacts, census, decisions, frozen, inputs, lifecycle, metrics, pooling, records, relations, scalars, settlement, sweeps  # noqa: F401
from ..streaming import checkpoints, flows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
