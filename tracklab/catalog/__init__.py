"""Registered queries: operators applied to the driver tables, each beside its SQL twin."""

import importlib
import pkgutil


def load_catalog() -> None:
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
