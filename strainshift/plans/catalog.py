"""All registered queries; importing the modules fills the registry."""

from strainshift.plans import (  # noqa: F401
    q_aggregates, q_joins, q_models, q_reshape, q_rows, q_search, q_scalars, q_sources, q_udfs, q_windows,
)
from strainshift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
