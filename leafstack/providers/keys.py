"""Keys of a service with limits: rotation, parking, back-off. State lives in one Python worker."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

LONG_WAIT, MOST_WAIT = 15.0, 8.0


class Refused(Exception):
    """A refusal with its status and, if told, the seconds to wait."""

    def __init__(self, status: int, wait: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.wait = status, wait


@dataclass
class KeyPool:
    """Calls an operation with one key after another until one answers.

    401 retires a key. 429 with a long wait parks it; with a short one the other keys are tried first and then the shortest
    wait is slept. Other faults back off. Without a usable key the answer is None.
    """

    keys: list[str]
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    dead: set[str] = field(default_factory=set)
    parked: dict[str, float] = field(default_factory=dict)

    def live(self) -> list[str]:
        now = self.clock()
        self.parked = {k: t for k, t in self.parked.items() if t > now}
        return [k for k in self.keys if k not in self.dead and k not in self.parked]

    def run(self, call: Callable[[str], str], rounds: int = 4) -> str | None:
        for attempt in range(rounds):
            waits: list[float] = []
            for key in self.live():
                try:
                    return call(key)
                except Refused as e:
                    if e.status == 401:
                        self.dead.add(key)
                    elif e.status == 429 and (e.wait or 0) > LONG_WAIT:
                        self.parked[key] = self.clock() + e.wait
                    elif e.status == 429:
                        waits.append(e.wait or 1.0)
                    elif e.status >= 500:
                        waits.append(min(0.5 * 2**attempt, MOST_WAIT) * random.uniform(0.5, 1))
                    else:
                        return None
            if not waits:
                return None
            self.sleep(min(waits))
        return None
