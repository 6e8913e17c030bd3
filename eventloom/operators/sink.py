"""Delivery of messages through a callable, with retries; a batch is a few rows, bounded by the alert limit."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.message import message

ATTEMPTS, PAUSE = 3, 3.0


def credentials(names: tuple[str, str] = ("MESSAGE_TOKEN", "MESSAGE_CHANNEL")) -> tuple[str, str] | None:
    """Both values from the environment, or none."""
    found = tuple((os.environ.get(n) or "").strip() for n in names)
    return found if all(found) else None


def deliver(text: str, send: Callable[[str], dict | None], attempts: int = ATTEMPTS, pause: float = PAUSE) -> bool:
    """True once ``send`` answers ok; errors and other answers are tried again."""
    for n in range(attempts):
        try:
            if (send(text) or {}).get("ok") is True:
                return True
        except OSError:
            pass
        if n + 1 < attempts:
            time.sleep(pause)
    return False


def messages(events: DataFrame) -> DataFrame:
    """url, message and guard of events: ``blocked`` unless today's, ``failed`` without a url, else empty."""
    url = F.trim(F.coalesce("url", F.lit("")))
    guard = F.when(~F.coalesce("is_today", F.lit(False)), "blocked").when(url == "", "failed").otherwise("")
    return events.select(url.alias("url"), message({c: F.col(c) for c in events.columns}).alias("message"), guard.alias("guard"))


def delivery_results(batch: DataFrame, send: Callable[[str], dict | None], pause: float = PAUSE) -> list[tuple[str, str]]:
    """(url, status) of each row of a batch that the alert limit bounds: sent, failed or blocked."""
    return [(r.url, r.guard or ("sent" if deliver(r.message, send, pause=pause) else "failed")) for r in messages(batch).collect()]


def send_alerts(batch: DataFrame, send: Callable[[str], dict | None], limit: int, pause: float = PAUSE) -> list[str]:
    """URLs delivered of at most ``limit`` rows."""
    return [url for url, status in delivery_results(batch.limit(limit), send, pause) if status == "sent"]
