"""Functions that run in Python workers travel by value: executors need not have this library installed."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(name: str) -> None:
    """From now on, what the named module defines is pickled by value."""
    for module in (name, f"{__package__}.hashing"):
        if module in sys.modules:
            cloudpickle.register_pickle_by_value(sys.modules[module])
