"""Calls to outside services from inside a batch function (STR-09): bounded retries, nothing else."""

from __future__ import annotations

import time
from collections.abc import Callable


def with_retry(call: Callable, transient: Callable[[Exception], bool], attempts: int = 3, first: float = 2.0, most: float = 20.0, budget: float = 45.0, sleep: Callable[[float], None] = time.sleep):
    """``call()`` up to ``attempts`` times while its errors are transient and the time budget lasts; waits double up to ``most``."""
    start, wait = time.monotonic(), first
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:
            if n == attempts or not transient(e) or time.monotonic() - start + wait > budget:
                raise
            sleep(wait)
            wait = min(most, 2 * wait)
