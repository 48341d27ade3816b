"""Registered queries by area; ``load`` fills the registry."""

from __future__ import annotations

import importlib

AREAS = ("scoring", "temporal", "backtest", "inputs", "graphs", "reads", "streams")


def load() -> None:
    for area in AREAS:
        importlib.import_module(f"tidemark.plans.catalog.{area}")
