"""Imports every query module so the registry is complete."""

from __future__ import annotations

from tillroll.plans import registry


def _load():
    from tillroll.plans import (basket_queries, elasticity_queries, explore_queries,  # noqa: F401
                                io_queries, metric_queries, model_queries, panel_queries,
                                tsa_queries)


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLES)
