"""Imports every query module so that the registry is full."""

import importlib
import pkgutil

import ostiary.plans as plans
from ostiary.plans.catalog import ORACLES, QUERIES

for module in pkgutil.iter_modules(plans.__path__):
    if module.name.startswith("q_"):
        importlib.import_module(f"ostiary.plans.{module.name}")

__all__ = ["ORACLES", "QUERIES"]
