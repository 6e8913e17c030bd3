"""Requests spaced by host: no host is asked again within ``pause`` seconds of its answer, and none waits for another."""

from __future__ import annotations

import heapq
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from urllib.parse import urlsplit

WIDTH = 8
WINDOW = 2_000


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").netloc.lower()
    except ValueError:
        return ""


def scheduled(urls: Iterable[str | None], ask: Callable[[str | None], tuple], pause: float = 0.0, width: int = WIDTH, window: int = WINDOW, wait_first: bool = False) -> Iterator[tuple]:
    """What ``ask`` gives for each address, in the order of the answers.

    Hosts stand in a queue by the time at which they may be asked next, which is ``pause`` after their last answer;
    up to ``width`` hosts are asked at once, a host never twice at once. Addresses are read ahead by ``window`` of them, so
    memory does not follow their number; answers that are not taken yet are at most ``width``. ``wait_first`` holds every
    host's first request back, too: another task may have asked it just now.
    """
    source, more = iter(urls), True
    queues: dict[str, deque] = {}
    ready: list[tuple[float, str]] = []  # hosts with addresses that are not being asked
    allowed: dict[str, float] = {}
    asked: dict[Future, str] = {}
    held, began = 0, time.monotonic()
    with ThreadPoolExecutor(width) as pool:
        try:
            while more or held or asked:
                while more and held < window:
                    try:
                        url = next(source)
                    except StopIteration:
                        more = False
                        break
                    host = host_of(url)
                    if host not in queues:
                        queues[host] = deque()
                        heapq.heappush(ready, (allowed.get(host, began + pause * wait_first), host))
                    queues[host].append(url)
                    held += 1
                now = time.monotonic()
                while ready and len(asked) < width and ready[0][0] <= now:
                    host = heapq.heappop(ready)[1]
                    asked[pool.submit(ask, queues[host].popleft())] = host
                    held -= 1
                next_at = ready[0][0] - time.monotonic() if ready and len(asked) < width else None
                if not asked:
                    if next_at and next_at > 0:
                        time.sleep(next_at)
                    continue
                for answer in wait(asked, None if next_at is None else max(0.0, next_at), FIRST_COMPLETED).done:
                    host = asked.pop(answer)
                    allowed[host] = time.monotonic() + pause
                    if queues[host]:
                        heapq.heappush(ready, (allowed[host], host))
                    else:
                        del queues[host]
                        if len(allowed) > 4 * window:  # forget hosts that may be asked again anyway
                            allowed = {h: t for h, t in allowed.items() if t > time.monotonic()}
                    yield answer.result()
        finally:
            for answer in asked:
                answer.cancel()
