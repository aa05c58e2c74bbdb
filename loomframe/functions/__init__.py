"""The function library: scalar functions, aggregates and window functions over columns."""

from . import binary, lists, media, misc, numeric, partitioning, strings, temporal, vectors  # noqa: F401
from . import ai  # noqa: F401
from .aggregates import *  # noqa: F403
from .base import REGISTRY

globals().update(REGISTRY)
