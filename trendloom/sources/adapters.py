"""What reaches outside: pages fetched with retries, in parallel and at a stated pace, by a function that the caller brings."""

from __future__ import annotations

import queue
import threading
import time
import urllib.parse
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TooManyRequests(Exception):
    """Raised by a fetching function that was asked to wait."""


def retried(fetch: Callable[[str], str], tries: int = 3, wait: float = 2.0, sleep: Callable[[float], Any] = time.sleep) -> Callable[[str], str | None]:
    """fetch with pauses between tries, longer each time where the site asks for it; None where all fail."""

    def run(address: str) -> str | None:
        for k in range(tries):
            try:
                return fetch(address)
            except TooManyRequests:
                sleep(wait * (k + 2))
            except Exception:  # whatever the fetching library raises counts as a failed try
                if k < tries - 1:
                    sleep(wait)
        return None

    return run


def paced(fetch: Callable[[str], Any], pause: float, sleep: Callable[[float], Any] = time.sleep) -> Callable[[str], Any]:
    """fetch with a pause after each call."""

    def run(address: str) -> Any:
        try:
            return fetch(address)
        finally:
            sleep(pause)

    return run


class Bucket:
    """A host's tokens: ``rate`` a second, up to ``burst`` at once; each call waits for its own."""

    def __init__(self, rate: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], Any] = time.sleep) -> None:
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at, self.lock = float(burst), clock(), threading.Lock()

    def take(self) -> None:
        with self.lock:
            now = self.clock()
            self.tokens = min(float(self.burst), self.tokens + (now - self.at) * self.rate) - 1
            self.at = now
            wait = max(0.0, -self.tokens / self.rate)  # tokens below none are those promised to others
        if wait:
            self.sleep(wait)


def host_of(address: str) -> str:
    return urllib.parse.urlsplit(address).netloc.lower()


def by_place(fetch: Callable[[str], Any], addresses: Sequence[str | None], in_flight: int = 4, limit: float = 30.0, before: Callable[[str], Any] = lambda address: None) -> list[Any]:
    """fetch of each address, in their order, so many at a time; None for what fails, or takes longer than ``limit`` seconds.

    ``before`` is called ahead of each fetch and does not count.  What runs beyond
    its time is left to itself, and the next takes its place.
    """
    out: list[Any] = [None] * len(addresses)
    events: queue.SimpleQueue = queue.SimpleQueue()
    ends: dict[int, float] = {}  # of those under way; infinite while they wait for their turn

    def one(k: int, address: str) -> None:
        before(address)
        events.put((k, True, None))
        try:
            events.put((k, False, fetch(address)))
        except Exception:  # whatever the fetching library raises is a page that could not be had
            events.put((k, False, None))

    def settle() -> None:
        """Waits until something happens, or the first of those under way is out of time."""
        try:
            k, begins, page = events.get(timeout=min(60.0, max(0.0, min(ends.values()) - time.monotonic())))
            if k in ends and begins:
                ends[k] = time.monotonic() + limit
            elif k in ends:
                out[k] = page
                del ends[k]
        except queue.Empty:
            for k in [k for k, end in ends.items() if end <= time.monotonic()]:
                del ends[k]

    for k, address in enumerate(addresses):
        if address is None:
            continue
        while len(ends) >= in_flight:
            settle()
        ends[k] = float("inf")
        threading.Thread(target=one, args=(k, address), daemon=True).start()
    while ends:
        settle()
    return out


def fetched(addresses: DataFrame, make: Callable[[], Callable[[str], str | None]], workers: int = 8, column: str = "url", in_flight: int = 4, limit: float = 30.0, rate: float | None = None, burst: int = 1) -> DataFrame:
    """addresses with the column ``html``, null where a page could not be had, or not within ``limit`` seconds.

    ``make`` builds the fetching function, once a task: a session, its retries
    and its pace.  All addresses of a host go to one task, which asks it for at
    most ``rate`` pages a second, and has at most ``in_flight`` requests open; a
    host that hangs or is slow holds up no other task.
    """
    kind = addresses.schema.simpleString()[len("struct<") : -1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch, buckets = make(), {}

        def before(address: str) -> None:
            if rate is not None:
                buckets.setdefault(host_of(address), Bucket(rate, burst)).take()

        for frame in frames:
            wanted = [None if a is None else str(a) for a in frame[column]]
            yield frame.assign(html=by_place(fetch, wanted, in_flight, limit, before))

    host = F.lower(F.regexp_extract(F.col(f"`{column}`"), r"^[^:/?#]+://([^/?#]*)", 1))
    return addresses.repartition(workers, host).mapInPandas(run, f"{kind},html:string")
