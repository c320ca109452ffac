"""All registered queries, one module per family."""

from __future__ import annotations

import importlib
from functools import lru_cache

from tallyforge.registry.core import Registry

FAMILIES = [
    "matching",
    "intake",
    "reports",
    "elt",
    "surface",
    "scalars",
    "evaluation",
    "streams",
]


@lru_cache(maxsize=1)
def load() -> Registry:
    registry = Registry()
    for family in FAMILIES:
        importlib.import_module(f"tallyforge.registry.{family}").register(registry)
    return registry
