"""Polite requests from several tasks: each task may begin a request to a host only at times of its own.

Time is cut into steps a little longer than the delay. Of every ``tasks`` steps of a host each task owns one, so two tasks never
begin requests to one host within the delay, however late a task runs, whichever executor runs it, and in the next level of a
crawl as well; nothing is said between tasks. A host's steps begin at an offset of its own, so that a task with many hosts isn't
free for all at the same moment. A task that comes to its step late waits for its next one. Machines' clocks have to agree to
within a tenth of the delay; without a delay nothing waits.
"""

from __future__ import annotations

import heapq
import time
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlsplit


def host_of(url: str) -> str:
    try:
        return urlsplit(url).netloc.lower()
    except ValueError:
        return ""


class Steps:
    """The times at which one of so many tasks may begin a request to a host."""

    def __init__(self, task: int, tasks: int, delay: float):
        self.task, self.tasks, self.slack = task, tasks, max(0.1, delay / 10) if delay else 0.0
        self.cycle = (delay + self.slack) * tasks

    def next(self, host: str, after: float) -> float:
        """The first at or after a time."""
        if not self.cycle:
            return after
        begin = self.cycle * (self.task / self.tasks + zlib.crc32(host.encode()) / (1 << 32))
        return begin + -(-(after - begin) // self.cycle) * self.cycle

    def missed(self, at: float, now: float) -> bool:
        return bool(self.cycle) and now > at + self.slack / 4


def paced(urls: Iterable[str], steps: Steps, attempt: Callable[[str], object], retries: int, delay: float, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[str, object]]:
    """Each URL with what attempt gives for it, or None after so many attempts that gave None; a further one comes later each time."""
    waiting: dict[str, deque[tuple[str, int]]] = {}
    for url in urls:
        waiting.setdefault(host_of(url), deque()).append((url, 1))
    now = clock()
    due = [(steps.next(host, now), host) for host in waiting]
    heapq.heapify(due)
    while due:
        at, host = heapq.heappop(due)
        if (now := clock()) < at:
            sleep(at - now)
            now = clock()
        if steps.missed(at, now):
            heapq.heappush(due, (steps.next(host, now), host))
            continue
        url, n = waiting[host].popleft()
        rest = 0.0
        if (found := attempt(url)) is None and n < retries:
            waiting[host].append((url, n + 1))
            rest = delay * n
        else:
            yield url, found
        if waiting[host]:
            heapq.heappush(due, (steps.next(host, max(clock() + (rest if len(waiting[host]) == 1 else 0.0), at + steps.slack)), host))
