"""What the engine says while it works: a logger, and a timer that writes to it."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

log = logging.getLogger("docweave")


@contextmanager
def timed(step: str, **facts) -> Iterator[None]:
    """Logs how long the block took, also when it fails; usable as a decorator."""
    start = time.perf_counter()
    end = "failed after"
    try:
        yield
        end = "took"
    finally:
        log.info("%s %s %.2f s%s", step, end, time.perf_counter() - start, "".join(f", {k}={v}" for k, v in facts.items()))
