"""Settings and observers of the process."""

from __future__ import annotations

import time
from collections.abc import Callable

from .session import execution_config, spark_session

execution_config_ctx = planning_config_ctx = execution_config

#: Called with a dict for each frame that is computed: what, seconds, rows.
SUBSCRIBERS: dict[str, Callable[[dict], None]] = {}


def set_execution_config(**settings) -> None:
    """Spark settings of the session; names with __ for dots."""
    for k, v in settings.items():
        spark_session().conf.set(k.replace("__", "."), v)


set_planning_config = set_execution_config


def set_runner_native(cores: int | str = "*"):
    """A session on this machine."""
    return spark_session(f"local[{cores}]")


def set_runner_cluster(master: str):
    """A session on a cluster."""
    return spark_session(master)


def attach_subscriber(alias: str, subscriber: Callable[[dict], None]) -> None:
    SUBSCRIBERS[alias] = subscriber


def detach_subscriber(alias: str) -> None:
    del SUBSCRIBERS[alias]


def observed(what: str, run: Callable[[], int]) -> int:
    """Runs, and tells subscribers."""
    began = time.perf_counter()
    rows = run()
    for tell in list(SUBSCRIBERS.values()):
        tell({"what": what, "seconds": time.perf_counter() - began, "rows": rows})
    return rows
