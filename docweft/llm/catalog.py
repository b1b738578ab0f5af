"""The queries and oracles of every operator module of this subpackage."""

from __future__ import annotations

import importlib
import pkgutil

import docweft.llm as package
from docweft.llm import registry


def _load() -> None:
    for module in pkgutil.iter_modules(package.__path__):
        if module.name not in ("registry", "catalog"):
            importlib.import_module(f"docweft.llm.{module.name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracles():
    _load()
    return dict(registry.ORACLES)
