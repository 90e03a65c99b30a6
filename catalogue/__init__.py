"""The query catalogue: importing a module registers its queries."""

from __future__ import annotations

import importlib
from typing import NamedTuple

from . import registry

MODULES = ("profile_queries", "prepare_queries", "evaluate_queries", "chart_queries", "source_queries", "model_queries")


class Catalogue(NamedTuple):
    queries: dict[str, registry.Query]
    oracles: dict[str, str]


def load() -> Catalogue:
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return Catalogue(registry.QUERIES, registry.ORACLES)
