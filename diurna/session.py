"""The session that the engine runs in, and a decorator that logs run times."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger("diurna")


def create_session(app: str = "diurna", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Executors and memory are the deployment's choice."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def timed(step: Callable) -> Callable:
    """Logs how many minutes a step took."""

    @functools.wraps(step)
    def run(*args, **kwargs):
        began = time.monotonic()
        try:
            return step(*args, **kwargs)
        finally:
            log.info("%s took %.2f minutes", step.__name__, (time.monotonic() - began) / 60)

    return run
