"""Imports every query module of the text operators so that the registry is full."""

import importlib
import pkgutil

import ostiary.llm as llm
from ostiary.llm.registry import ORACLES, QUERIES

for module in pkgutil.iter_modules(llm.__path__):
    if module.name.startswith("q_"):
        importlib.import_module(f"ostiary.llm.{module.name}")

__all__ = ["ORACLES", "QUERIES"]
