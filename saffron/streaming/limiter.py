"""A token bucket: `rate` calls a second on average, `capacity` at once."""

from __future__ import annotations

import threading
import time
from contextlib import contextmanager


class TokenBucket:
    def __init__(self, rate: float, capacity: int, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.capacity, self.clock, self.sleep = rate, capacity, clock, sleep
        self.tokens, self.last = float(capacity), clock()

    @classmethod
    def per_minute(cls, calls: float, **more) -> TokenBucket:
        """As many at once as are due in ten seconds."""
        return cls(calls / 60, max(1, int(calls // 6)), **more)

    def acquire(self, blocking: bool = True, timeout: float | None = None) -> bool:
        """Takes a token, after waiting for it if need be; False if there is none (in time)."""
        start = self.clock()
        while True:
            now = self.clock()
            self.tokens = min(self.capacity, self.tokens + (now - self.last) * self.rate)
            self.last = now
            if self.tokens >= 1:
                self.tokens -= 1
                return True
            wait = (1 - self.tokens) / self.rate
            if not blocking or timeout is not None and now - start + wait > timeout:
                return False
            self.sleep(wait)


class Limiter:
    """A token bucket whose calls also share a number of slots; threads of one process may use it together."""

    def __init__(self, bucket: TokenBucket, at_once: int):
        self.bucket, self.lock, self.slots = bucket, threading.Lock(), threading.BoundedSemaphore(at_once)

    @contextmanager
    def call(self, timeout: float | None = None):
        """Holds a slot while its body runs; TimeoutError if no slot or token comes free in time."""
        if not self.slots.acquire(timeout=timeout):
            raise TimeoutError("no slot came free")
        try:
            with self.lock:
                if not self.bucket.acquire(timeout=timeout):
                    raise TimeoutError("no token came free")
            yield
        finally:
            self.slots.release()
