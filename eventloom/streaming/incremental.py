"""Incremental runs: each micro-batch, and each run that finds nothing new, is a step of the ledger."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from eventloom.operators.sink import PAUSE
from eventloom.plans.pipeline import ALERTS
from eventloom.sources import files
from eventloom.streaming.ledger import DONE, Ledger


def state_table(spark: SparkSession, path: str) -> DataFrame:
    """The urls that the ledger at ``path`` has sent."""
    return Ledger(spark, path).sent().where(f"status = '{DONE}'").select("url")


def deliver_new(batch: DataFrame, state: str, send: Callable[[str], dict | None], limit: int = ALERTS, pause: float = PAUSE) -> list[str]:
    """Deliver the best of a batch's new events and of those that wait; what is left waits in the ledger."""
    return [u for u, status in Ledger(batch.sparkSession, state).deliver(batch, send, limit, pause=pause) if status == DONE]


class IncrementalRun:
    """A started run. Once its stream is worked off, a run that saw no micro-batch takes a step over the backlog."""

    def __init__(self, query: StreamingQuery, ledger: Ledger, began: int, step: Callable[[], object]):
        self.query, self._ledger, self._began, self._step = query, ledger, began, step

    def awaitTermination(self, timeout: int | None = None) -> bool | None:  # noqa: N802 (as StreamingQuery has it)
        ended = self.query.awaitTermination(timeout) if timeout else self.query.awaitTermination()
        if not self.query.isActive and self._ledger.last()[0] == self._began:
            self._step()
        return ended


def run_stream(events: DataFrame, state: str, checkpoint: str, send: Callable[[str], dict | None], limit: int = ALERTS, pause: float = PAUSE) -> IncrementalRun:
    """Work off what is there and stop. Events over the limit, and events whose delivery failed, wait in the ledger and
    go out in later runs, whether or not the source shows them again; a micro-batch that is replayed sends nothing twice."""
    ledger = Ledger(events.sparkSession, state)

    def step(batch: DataFrame, number: int) -> None:
        stream = json.loads(files.get(events.sparkSession, f"{checkpoint}/metadata"))["id"]
        Ledger(batch.sparkSession, state).deliver(batch, send, limit, (stream, number), pause=pause)

    began = ledger.last()[0]
    query = events.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(step).start()
    return IncrementalRun(query, ledger, began, lambda: ledger.deliver(None, send, limit, pause=pause))


def first_seen(events: DataFrame, time: str, key: str = "url", delay: str = "30 days") -> DataFrame:
    """Bounded state: a key is new again once the watermark has passed it."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
