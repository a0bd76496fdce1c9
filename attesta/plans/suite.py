"""All registered queries."""

from attesta.plans import q_basic, q_chain, q_detect, q_drift, q_graph, q_models, q_stream  # noqa: F401
from attesta.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
