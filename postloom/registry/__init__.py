"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = ["vectors", "tables", "texts", "topics", "profiles", "times", "samples", "joined", "files", "models", "streams"]


def load() -> tuple[dict, dict]:
    from postloom.registry import base

    for name in MODULES:
        importlib.import_module(f"postloom.registry.{name}")
    return dict(base.QUERIES), dict(base.ORACLES)
