"""The ledger of incremental delivery: what was sent, what waits, and what a broken run had begun.

A step is one delivery of at most ``limit`` messages, of a micro-batch or of the backlog alone. Its life:

1. The rows that waited and the new rows are put together, the earliest row of each url, without what was sent.
2. The best rows are sent. Before each message a mark ``begun`` is written, after it ``sent`` or ``failed``.
3. What was sent is written to the step's part of ``sent``, every other row to the step's ``pending``: rows over the limit
   and rows whose delivery failed wait for a later step, whether or not the source shows them again.
4. The commit file of the step, which names the stream's micro-batch, ends it. Marks and older pending rows go then.

A replay of a committed micro-batch does nothing. A replay of one that broke counts the marks: a url that was sent is not
sent again, and neither is one that was begun and has no answer (``unsure``: the sink may or may not have it; it is listed
in ``sent`` with that status). So every message goes out once at most, and all but unsure ones once in the end.

One run at a time owns a ledger. Rows without a url cannot be told apart, and rows that are not of the day are not to be
sent: neither are kept.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.message import message
from eventloom.operators.durable import durable
from eventloom.operators.select import first_per_key, top_rows
from eventloom.operators.sink import PAUSE, deliver
from eventloom.sources import files
from eventloom.sources.sent import reject

SENT = "url string, status string"
BEGUN, DONE, FAILED, UNSURE = "begun", "sent", "failed", "unsure"


class Ledger:
    """The tables under ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def last(self) -> tuple[int, dict[str, int]]:
        """The last committed step, -1 before the first, and the last micro-batch that is in it of each stream."""
        found = files.names(self.spark, f"{self.path}/commits")
        return (int(found[-1]), json.loads(files.get(self.spark, f"{self.path}/commits/{found[-1]}"))) if found else (-1, {})

    def sent(self) -> DataFrame:
        """url, status and step of everything that was sent in committed steps."""
        step = self.last()[0]
        if step < 0 or not files.names(self.spark, f"{self.path}/sent"):
            return self.spark.createDataFrame([], f"{SENT}, step long")
        return self.spark.read.schema(f"{SENT}, step long").parquet(f"{self.path}/sent").where(F.col("step") <= step)

    def pending(self) -> DataFrame | None:
        """The rows that wait, with ``since``, the step that saw them first; none before the first step."""
        step = self.last()[0]
        return None if step < 0 else self.spark.read.parquet(f"{self.path}/pending/{step:012d}")

    def marks(self) -> dict[str, str]:
        """Last mark of each url in steps that did not end; an answer outweighs a beginning."""
        out: dict[str, str] = {}
        for step in files.names(self.spark, f"{self.path}/marks"):
            for name in files.names(self.spark, f"{self.path}/marks/{step}"):
                status, url = files.get(self.spark, f"{self.path}/marks/{step}/{name}").split("\n", 1)
                if out.get(url) in (None, BEGUN):
                    out[url] = status
        return {u: UNSURE if s == BEGUN else s for u, s in out.items()}

    def _mark(self, step: int, url: str, status: str) -> None:
        files.put(self.spark, f"{self.path}/marks/{step:012d}/{hashlib.sha256(url.encode()).hexdigest()}.{status}", f"{status}\n{url}")

    def _commit(self, step: int, streams: dict[str, int]) -> None:
        files.put(self.spark, f"{self.path}/commits/{step:012d}", json.dumps(streams))
        files.drop(self.spark, f"{self.path}/marks")
        for folder in ("commits", "pending"):
            for name in files.names(self.spark, f"{self.path}/{folder}"):
                if int(name) < step:
                    files.drop(self.spark, f"{self.path}/{folder}/{name}")

    def deliver(self, new: DataFrame | None, send: Callable[[str], dict | None], limit: int, batch: tuple[str, int] | None = None, score: str = "verification_score", order: str = "ord", pause: float = PAUSE) -> list[tuple[str, str]]:
        """One step over the backlog and ``new``, which is a stream's micro-batch if ``batch`` names both; (url, status) of
        what it sent or tried. Nothing happens if the micro-batch is committed, or if there is nothing at all."""
        last, streams = self.last()
        if batch and batch[1] <= streams.get(batch[0], -1):
            return []
        step, marks, rows = last + 1, self.marks(), self.pending()
        if new is not None:
            clean = new.withColumns({"url": F.trim(F.coalesce("url", F.lit(""))), "since": F.lit(step).cast("long")})
            rows = clean if rows is None else rows.unionByName(clean)
        if rows is None:
            return []
        of_the_day = rows.where("url <> ''").where(F.coalesce("is_today", F.lit(False)))
        first = first_per_key(of_the_day.withColumn("__at", F.struct("since", order)), F.col("url"), "__at").drop("__at")
        settled, tried = [u for u, s in marks.items() if s != FAILED], list(marks)
        waiting = durable(_without(reject(first, self.sent()), settled))
        best = top_rows(_without(waiting, tried), score, order, max(0, limit - len(tried)))
        results = list(marks.items())
        for r in best.select("url", message({c: F.col(c) for c in waiting.columns}).alias("text")).collect():
            self._mark(step, r.url, BEGUN)
            status = DONE if deliver(r.text, send, pause=pause) else FAILED
            self._mark(step, r.url, status)
            results.append((r.url, status))
        gone = [(u, s) for u, s in results if s != FAILED]
        if gone:
            self.spark.createDataFrame(gone, SENT).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sent/step={step}")
        _without(waiting, [u for u, _ in gone]).write.mode("overwrite").parquet(f"{self.path}/pending/{step:012d}")
        self._commit(step, streams | ({batch[0]: batch[1]} if batch else {}))
        return results


def _without(rows: DataFrame, urls: list[str]) -> DataFrame:
    """Rows of other urls than a few, which the limit of a step bounds."""
    return rows.where(~F.col("url").isin(urls)) if urls else rows
