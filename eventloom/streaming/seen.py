"""First-seen rows of a stream with state that expires: a key is new if it was not seen for ``ttl``.

``transformWithState`` keeps one value a key: when its present run of sightings began and last went on, and how many rows
it has had. Rows of a micro-batch are folded into runs whose gaps are under ``ttl``, ``FRAME`` rows at a time, so a hot key
holds its runs, not its rows. The first row of a run that does not continue the stored one is handed on. An event-time timer
drops the state once the watermark has passed the last sighting by ``ttl``: state is bounded by the keys of that time.
Most keys have a few rows a micro-batch, so rows come as tuples, without a frame a key, and a key asks the state store no
more than it must: the timer that is set follows from the stored end, so it is not looked up.

Defined cases: rows with a null time or key are dropped; rows older than the watermark are late and Spark drops them; a row
that comes out of order, but not late, joins the run it falls in, and older runs that turn up are handed on as well; of
rows at the same time the one of the least ``order`` is first.

The state store must be RocksDB: take ``stateful(spark)``, a session of its own, for reading, or set it at the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAME = 4096


def stateful(spark: SparkSession) -> SparkSession:
    """A session beside the caller's whose streams can keep state of transformWithState."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return own


class _Runs(StatefulProcessor):
    """State: begin, end (microseconds) and rows of a key's last run. ``columns``: what a row's fields are handed on as."""

    def __init__(self, ttl: int, order: str, columns: dict[str, str] | list[str]):
        self.ttl, self.order, self.columns = ttl, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "begin long, end long, rows long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        head = list(islice(rows, FRAME))
        runs = self._few([(r["at_"], r["at_"], 1, r) for r in head]) if len(head) < FRAME else self._many(head, rows)
        if not runs:
            return
        stored = self.state.get()
        fresh = runs
        if stored:
            begin, end, count = stored
            fresh = [r for r in runs if r[0] - end >= self.ttl or begin - r[1] >= self.ttl]
            last = self._few([*runs, (begin, end, count, None)])[-1]
        else:
            last = runs[-1]
        if not stored or last[1] != end:
            if stored:
                self.handle.deleteTimer(self._expiry(end))
            self.handle.registerTimer(self._expiry(last[1]))
        self.state.update(last[:3])
        for r in fresh:
            yield Row(**{name: r[3][c] for name, c in self.columns.items()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def _expiry(self, end: int) -> int:
        return (end + self.ttl) // 1000 + 1

    def _few(self, runs: list[tuple]) -> list[tuple]:
        """(begin, end, rows, first row) of runs, sorted and those with gaps under the ttl made one."""
        out: list[tuple] = []
        for run in sorted(runs, key=self._place):
            if out and run[0] - out[-1][1] < self.ttl:
                begin, end, count, first = out[-1]
                out[-1] = (begin, max(end, run[1]), count + run[2], first)
            else:
                out.append(run)
        return out

    def _place(self, run: tuple) -> tuple:
        order = run[3] and run[3][self.order]
        return run[0], order is None, order

    def _many(self, head: list[Row], rows: Iterator[Row]) -> list[tuple]:
        """The same of a hot key's rows, frame by frame."""
        runs: pd.DataFrame | None = None
        while head:
            runs = self._folded(runs, pd.DataFrame({"at_": [r["at_"] for r in head], self.order: [r[self.order] for r in head], "row_": pd.Series(head, dtype=object)}))
            head = list(islice(rows, FRAME))
        return list(zip(*[runs[c].tolist() for c in ("begin_", "end_", "rows_", "row_")], strict=True))

    def _folded(self, runs: pd.DataFrame | None, frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.assign(begin_=frame["at_"], end_=frame["at_"], rows_=1)
        both = own if runs is None else pd.concat([runs, own])
        return self._joined(both.sort_values(["begin_", self.order], kind="stable"))

    def _joined(self, runs: pd.DataFrame) -> pd.DataFrame:
        """Runs sorted by begin, those with gaps under the ttl made one; the first one's columns stay."""
        reach = runs["end_"].cummax()
        number = (runs["begin_"] - reach.shift() >= self.ttl).cumsum().to_numpy()
        out = runs[~pd.Series(number, index=runs.index).duplicated().to_numpy()].copy()
        out["end_"] = runs["end_"].groupby(number).max().to_numpy()
        out["rows_"] = runs["rows_"].groupby(number).sum().to_numpy()
        return out


def first_seen_within(events: DataFrame, time: str, key: str, ttl: str, delay: str, order: str) -> DataFrame:
    """The rows of a stream whose ``key`` was not seen for ``ttl`` (an interval such as ``6 hours``); rows more than
    ``delay`` behind the latest one are late."""
    micros = int(pd.Timedelta(ttl).total_seconds() * 1_000_000)
    usable = events.where(F.col(time).isNotNull() & F.col(key).isNotNull()).withWatermark(time, delay).withColumn("at_", F.unix_micros(time))
    # Points of time pass Python as numbers, which no time zone changes; the time itself stays beside, for its watermark.
    stamps = [f.name for f in events.schema if isinstance(f.dataType, TimestampType) and f.name != time]
    held = StructType([StructField(f.name, LongType() if f.name in [*stamps, time] else f.dataType) for f in events.schema])
    found = usable.withColumns({c: F.unix_micros(c) for c in stamps}).groupBy(key).transformWithState(
        statefulProcessor=_Runs(micros, order, {c: "at_" if c == time else c for c in events.columns}), outputStructType=held, outputMode="Append", timeMode="EventTime"
    )
    return found.select(*[F.timestamp_micros(c).alias(c) if c in [*stamps, time] else c for c in events.columns])
