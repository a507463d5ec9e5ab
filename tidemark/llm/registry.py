"""Queries of this subpackage and their DuckDB equivalents, where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from . import stages, topk

_MODULES = {
    "op1_topk": "topk",
    "op2_simhash": "simhash",
    "op3_sharding": "sharding",
    "op4_html": "pages",
    "op5_packing": "packing",
    "op6_ann": "ann",
    "op7_pii": "pii",
    "op8_quality": "quality",
    "op9_url_filter": "urlrank",
    "op10_bpe": "bpe",
    "op11_mixing": "mixing",
    "op12_periods": "periods",
    "op13_spelling": "spelling",
}


def queries() -> dict[str, Callable]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}
    return found | {"pipeline": stages.run}


def oracles() -> dict[str, str]:
    return {"op1_topk": topk.ORACLE_OP1}
