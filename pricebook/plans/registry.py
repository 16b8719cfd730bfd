"""All registered queries, gathered from the plan modules."""

import importlib

from pricebook.plans.fixtures import Tables

MODULES = ("relational", "search", "stats", "quality", "scalars", "identify", "grid", "items",
           "load", "correct", "evaluate", "runs", "monitor", "sources")


def _load():
    plans = {}
    for m in MODULES:
        plans.update(importlib.import_module(f"pricebook.plans.q_{m}").PLANS)
    return plans


def _bind(fn):
    return lambda spark, sf_dir: fn(Tables(spark, sf_dir))


def queries():
    return {name: _bind(fn) for name, (fn, _) in _load().items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _load().items() if sql}
