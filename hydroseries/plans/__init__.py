"""Named queries over the given tables, with an equivalent SQL text where one exists."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every module of this package, so that its queries register."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
