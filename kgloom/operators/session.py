"""State a driver keeps for a question and answer session: result cache, retries, pinned data set."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable


class ResultCache:
    """Entries live ``ttl`` seconds; beyond ``most`` the one inserted first goes."""

    def __init__(self, ttl: float = 300, most: int = 1000, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.most, self.clock = ttl, most, clock
        self.kept: OrderedDict[str, tuple[float, object]] = OrderedDict()

    def get(self, key: str):
        at, value = self.kept.get(key, (None, None))
        if at is None:
            return None
        if self.clock() - at > self.ttl:
            del self.kept[key]
            return None
        return value

    def put(self, key: str, value: object) -> None:
        self.kept.pop(key, None)
        self.kept[key] = (self.clock(), value)
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)


def with_retries(call: Callable, transient: tuple[type[Exception], ...], attempts: int = 4, first: float = 0.5, sleep: Callable[[float], None] = time.sleep):
    """The call's result; transient errors are tried again after .5, 1, 2 ... seconds, others at once raised."""
    for n in range(attempts):
        try:
            return call()
        except transient:
            if n == attempts - 1:
                raise
            sleep(first * 2**n)


class DatasetPin:
    """A chosen data set answers the next ``turns`` questions and then expires."""

    def __init__(self, turns: int = 3):
        self.turns, self.left, self.name = turns, 0, None

    def choose(self, name: str) -> None:
        self.name, self.left = name, self.turns

    def current(self) -> str | None:
        if self.left <= 0:
            self.name = None
            return None
        self.left -= 1
        return self.name
