"""Imports every query module so their keys register."""

from __future__ import annotations

import importlib

MODULES = ["prices", "biomarkers", "modelprep", "evaluation", "fundamentals", "language", "modelling", "search"]


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"tessera.plans.{m}")
