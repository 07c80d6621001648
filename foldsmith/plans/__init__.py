"""Registered queries over the given tables, each with its SQL check where SQL can say it."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every module of this package, which fills the registry."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
