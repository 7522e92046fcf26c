"""Rate limits, retries and lookups for connector functions."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable

from pyspark.sql import functions as F

from ..lake import Lake


class RateLimit:
    """A token bucket: ``n`` calls per ``seconds``, shared by all threads."""

    def __init__(self, n: int, seconds: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.most, self.left = n / seconds, float(n), float(n)
        self.clock, self.sleep, self.at, self.lock = clock, sleep, clock(), threading.Lock()

    def take(self) -> None:
        with self.lock:
            now = self.clock()
            self.left = min(self.most, self.left + (now - self.at) * self.rate)
            self.at = now
            self.left -= 1
            wait = -self.left / self.rate
        if wait > 0:
            self.sleep(wait)


class Retry(Exception):
    """Raised by a call that may be tried again; ``after`` is what the other side asks to wait."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


def with_retries(fn: Callable, tries: int = 5, backoff: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """Call until it succeeds; waits double, with some jitter, unless the other side named one."""
    for i in range(tries):
        try:
            return fn()
        except Retry as e:
            if i == tries - 1:
                raise
            sleep(e.after if e.after is not None else backoff * 2**i * (1 + 0.1 * random.random()))
    return None


def retryable(status: int) -> bool:
    return status == 429 or status >= 500


def lookup(lake: Lake, table: str, key: str, value: str, keys: list | None = None, where: str | None = None) -> dict:
    """key -> value of a table, {} if it is missing; ``keys`` bounds what is read."""
    if not lake.exists(table):
        return {}
    df = lake.read(table)
    if where:
        df = df.where(where)
    if keys is not None:
        df = df.where(F.col(f"`{key}`").isin(keys))
    return {r[0]: r[1] for r in df.select(F.col(f"`{key}`"), F.col(f"`{value}`")).toLocalIterator()}
