"""All registered analyses; importing the modules fills the registry."""

from __future__ import annotations

from gravis.plans import q_clean, q_models, q_rates, q_stats  # noqa: F401
from gravis.plans.registry import COVERS, ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)


def covers():
    return dict(COVERS)
