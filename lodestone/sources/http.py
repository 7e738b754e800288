"""A polite fetcher for connectors: retries with back-off, a least interval for each host, a cool-down after failures.

It runs on executors inside a connector that fills the table of answers; plans never call it. One instance serves one
worker, so ``interval`` is for one worker: set it to the service's limit times the number of workers.
"""

from __future__ import annotations

import re
import time
from calendar import timegm
from collections.abc import Callable, Iterator
from email.utils import parsedate_tz
from urllib.parse import urlparse

#: Attempts, first delay and longest delay in seconds, statuses worth another attempt, least seconds between calls (fixed values).
ATTEMPTS, BACKOFF, LONGEST = 4, 1.0, 10.0
RETRIED = frozenset({429, 500, 502, 503, 504})
INTERVALS = {"eutils.ncbi.nlm.nih.gov": 0.4, "api.semanticscholar.org": 1.0}


def asked_for(header: str | None, now: float) -> float | None:
    """Seconds that a Retry-After header names, as a number or as a date (UTC unless it says otherwise); None if it names none."""
    if header is None:
        return None
    if re.fullmatch(r"\s*[-+]?\d+(\.\d*)?\s*", header):
        return float(header)
    date = parsedate_tz(header)
    return None if date is None else timegm(date[:6] + (0, 0, 0)) - (date[9] or 0) - now


def delay(attempt: int, retry_after: str | None, now: float | None = None) -> float:
    """Seconds to wait after a failed attempt (from 0): what the service asks for, else doubling; never more than ``LONGEST``."""
    wait = asked_for(retry_after, time.time() if now is None else now)
    return max(0.0, min(LONGEST, BACKOFF * 2**attempt if wait is None else wait))


class Fetcher:
    """Calls ``send(url) -> (status, headers, body)``; clock and sleep can be replaced in tests."""

    def __init__(self, send: Callable, intervals: dict[str, float] | None = None, cool_down: float = 60.0, clock=time.monotonic, sleep=time.sleep):
        self.send, self.intervals, self.cool_down, self.clock, self.sleep = send, INTERVALS if intervals is None else intervals, cool_down, clock, sleep
        self.last: dict[str, float] = {}
        self.closed: dict[str, float] = {}

    def _wait(self, host: str) -> None:
        rest = self.intervals.get(host, 0.0) - (self.clock() - self.last.get(host, float("-inf")))
        if rest > 0:
            self.sleep(rest)
        self.last[host] = self.clock()

    def get(self, url: str) -> tuple[int, bytes | None]:
        """(status, body) of the last attempt; status 0 while the host cools down after it gave up or refused."""
        host = urlparse(url).netloc.lower()
        if self.closed.get(host, float("-inf")) > self.clock():
            return 0, None
        status, body = 0, None
        for attempt in range(ATTEMPTS):
            self._wait(host)
            status, headers, body = self.send(url)
            if status not in RETRIED:
                break
            if attempt + 1 < ATTEMPTS:
                self.sleep(delay(attempt, {k.lower(): v for k, v in headers.items()}.get("retry-after")))
        if status in RETRIED or status == 403:
            self.closed[host] = self.clock() + self.cool_down
        return status, body


def fetched(send: Callable) -> Callable[[Iterator], Iterator]:
    """For ``mapInPandas`` over (source, query, page, url): rows (source, query, page, status, payload) of the table of answers."""

    def run(batches):
        one = Fetcher(send)
        for batch in batches:
            got = [one.get(u) for u in batch["url"]]
            out = batch[["source", "query", "page"]].copy()
            out["status"] = [s for s, _ in got]
            out["payload"] = [b.decode("utf-8", "replace") if s == 200 and b is not None else None for s, b in got]
            yield out

    return run
