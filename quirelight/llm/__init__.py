"""Operators for training-data pipelines. queries() and oracle_sql() are what __spark_entry__.py registers."""

from __future__ import annotations

import importlib

#: Module and query of each operator.
MODULES = {
    "op1_simhash": "simhash",
    "op2_suffix": "suffix",
    "op3_brown_lm": "lm",
    "op4_packing": "packing",
    "op5_bpe": "bpe",
    "op6_quality_rules": "quality",
    "op7_line_templates": "templates",
    "op8_chat_format": "chat",
    "op9_merkle": "merkle",
    "op10_shuffled_shards": "sharding",
    "op11_centroids": "centroids",
    "op12_repair": "repair",
    "op13_token_counts": "counts",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__name__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in MODULES.items():
        sql = getattr(importlib.import_module(f"{__name__}.{module}"), f"{name.split('_')[0].upper()}_SQL", None)
        if sql:
            out[name] = sql
    return out
