"""Retries of remote requests: transient failures only, capped exponential backoff with full jitter."""

from __future__ import annotations

import dataclasses
import random
import re
import time
from collections.abc import Callable
from typing import TypeVar

from ..operators.transfer import MISSING, TRANSIENT

R = TypeVar("R")


@dataclasses.dataclass(frozen=True)
class RetryPolicy:
    retries: int = 0
    base_seconds: float = 0.1
    most_seconds: float = 2.0

    def delay(self, attempt: int, rng: random.Random) -> float:
        """Before the retry after `attempt` failures (from 1)."""
        return rng.uniform(0, min(self.most_seconds, self.base_seconds * 2 ** min(attempt - 1, 60)))


class RemoteError(Exception):
    """kind: missing, transient, permanent or corrupt."""

    def __init__(self, message: str, kind: str):
        super().__init__(message)
        self.kind = kind


def kind_of_status(code: int) -> str | None:
    if 200 <= code < 300:
        return None
    return "missing" if code in MISSING else "transient" if code in TRANSIENT else "permanent"


def kind_of_message(message: str) -> str:
    """For errors known by text alone (`HTTP 503 ...`); without a status they are permanent."""
    m = re.search(r"HTTP ([0-9]{3})\b", message)
    return kind_of_status(int(m[1])) or "permanent" if m else "permanent"


def with_retries(call: Callable[[], R], policy: RetryPolicy, seed: int | None = None, sleep: Callable[[float], None] = time.sleep) -> tuple[R, int]:
    """(result, retries made)."""
    rng = random.Random(seed)
    for attempt in range(1, policy.retries + 2):
        try:
            return call(), attempt - 1
        except RemoteError as e:
            if e.kind != "transient" or attempt > policy.retries:
                raise
            sleep(policy.delay(attempt, rng))
    raise AssertionError
