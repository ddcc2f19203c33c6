"""Registered queries with their independent SQL checks."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

AREAS = ("traffic", "usage", "intake", "pages", "text", "layout", "metadata", "catalog", "edits", "live")


def load_all() -> tuple[dict, dict]:
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
    return dict(QUERIES), dict(ORACLES)
