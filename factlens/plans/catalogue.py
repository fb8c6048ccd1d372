"""All registered queries and their oracle SQL."""

from __future__ import annotations

import importlib

MODULES = ["probe", "prompts", "neighbours", "runs", "parsing", "embeddings", "beliefs", "texts", "shuffles"]


def _load():
    queries, oracle = {}, {}
    for m in MODULES:
        mod = importlib.import_module(f"factlens.plans.{m}")
        for k, v in mod.QUERIES.items():
            if k in queries:
                raise ValueError(f"duplicate query {k}")
            queries[k] = v
        oracle.update(mod.ORACLE)
    return queries, oracle


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
