"""Restart policy of a streaming query: exponential backoff, a limit of crashes, reset after a quiet time."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass


@dataclass
class RestartPolicy:
    first: float = 1.0
    longest: float = 60.0
    crashes: int = 10
    quiet: float = 300.0

    def delay(self, crash: int) -> float:
        """Seconds before the restart after the n-th crash in a row."""
        return min(self.longest, self.first * 2 ** (crash - 1))


def supervise(run: Callable[[], None], policy: RestartPolicy = RestartPolicy(), clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> int:
    """Call ``run`` (start a query and await its end) until it returns; the number of crashes on the way.

    After ``policy.crashes`` crashes in a row, the last error is raised; a run that lasted ``policy.quiet`` seconds
    starts the count anew. A streaming query resumes from its checkpoint.
    """
    total = row = 0
    while True:
        began = clock()
        try:
            run()
            return total
        except Exception:
            total += 1
            row = 1 if clock() - began >= policy.quiet else row + 1
            if row >= policy.crashes:
                raise
            sleep(policy.delay(row))
