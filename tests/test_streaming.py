"""Delivery over several runs, broken and replayed ones too; stateful first-seen rows; the table of sent urls."""

import collections
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventloom.operators import select
from eventloom.sources import files
from eventloom.sources.sent import SentTable, reject
from eventloom.streaming import ledger as ledgers
from eventloom.streaming.incremental import run_stream, state_table
from eventloom.streaming.seen import _Runs, first_seen_within, stateful

EVENT = "ord int, url string, title string, verification_score int, is_today boolean"


def events(spark, ids, score=lambda i: 50 + i):
    return spark.createDataFrame([(i, f"https://e.org/{i}", f"T{i}", score(i), True) for i in ids], EVENT)


class Sink:
    """Answers, refuses some titles, and breaks the run after some messages."""

    def __init__(self, refuse=(), break_after=None):
        self.got, self.refuse, self.left = [], set(refuse), break_after

    def __call__(self, text):
        title = text.split("<b>")[-1].split("\n")[0] if "<b>" in text else text
        name = next(w for w in text.replace("<", " ").replace(">", " ").split() if w.startswith("T") and w[1:].isdigit())
        if name in self.refuse:
            return {"ok": False}
        self.got.append(name)
        if self.left is not None:
            self.left -= 1
            if self.left == 0:
                raise KeyboardInterrupt(title)
        return {"ok": True}


def stream(spark, tmp_path, sink, limit=10):
    source = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    run_stream(source, str(tmp_path / "state"), str(tmp_path / "ck"), sink, limit, pause=0).awaitTermination()


def test_a_backlog_is_worked_off_over_runs(spark, tmp_path):
    events(spark, range(12)).write.parquet(str(tmp_path / "in"))
    sink = Sink()
    for want in (10, 12, 12):
        stream(spark, tmp_path, sink)
        assert len(sink.got) == want
    assert collections.Counter(sink.got) == collections.Counter(f"T{i}" for i in range(12))
    assert sink.got[:10] == [f"T{i}" for i in range(11, 1, -1)]
    assert state_table(spark, str(tmp_path / "state")).count() == 12
    assert ledgers.Ledger(spark, str(tmp_path / "state")).pending().count() == 0


def test_failed_deliveries_and_new_events_share_the_limit(spark, tmp_path):
    folder = str(tmp_path / "in")
    events(spark, range(4)).write.parquet(folder)
    stream(spark, tmp_path, Sink(refuse={"T3"}), limit=2)
    events(spark, range(10, 12), score=lambda i: 10).unionByName(events(spark, [2])).write.mode("append").parquet(folder)
    sink = Sink()
    stream(spark, tmp_path, sink, limit=3)
    assert sink.got == ["T3", "T1", "T0"]  # T2 was sent before; the new ones have lower scores
    stream(spark, tmp_path, sink, limit=3)
    assert sorted(sink.got[3:]) == ["T10", "T11"]


def test_a_broken_run_is_replayed_without_sending_twice(spark, tmp_path):
    events(spark, range(12)).write.parquet(str(tmp_path / "in"))
    broken = Sink()

    def breaks(*_):
        raise OSError("lost before the state was saved")

    with pytest.MonkeyPatch.context() as m:
        m.setattr(ledgers.Ledger, "_commit", breaks)
        with pytest.raises(Exception, match="lost"):
            stream(spark, tmp_path, broken)
    assert len(broken.got) == 10 and state_table(spark, str(tmp_path / "state")).count() == 0
    sink = Sink()
    stream(spark, tmp_path, sink)  # the same micro-batch again: nothing of it is left to try
    assert sink.got == []
    stream(spark, tmp_path, sink)
    assert sorted(sink.got) == ["T0", "T1"] and len(set(broken.got + sink.got)) == 12
    assert state_table(spark, str(tmp_path / "state")).count() == 12


def test_a_message_without_an_answer_is_unsure(spark, tmp_path):
    at = ledgers.Ledger(spark, str(tmp_path / "state"))
    with pytest.raises(KeyboardInterrupt):
        at.deliver(events(spark, range(5)), Sink(break_after=2), 4, ("s", 0), pause=0)
    assert at.marks() == {"https://e.org/4": "sent", "https://e.org/3": "unsure"}
    sink = Sink()
    got = dict(at.deliver(events(spark, range(5)), sink, 4, ("s", 0), pause=0))
    assert sink.got == ["T2", "T1"] and got["https://e.org/3"] == "unsure" and at.marks() == {}
    assert at.deliver(events(spark, range(5)), sink, 4, ("s", 0), pause=0) == []
    assert {r.url: r.status for r in at.sent().collect()} == {f"https://e.org/{i}": "unsure" if i == 3 else "sent" for i in range(1, 5)}
    at.deliver(None, sink, 4, pause=0)
    assert sink.got[2:] == ["T0"] and at.last()[1] == {"s": 0}
    at.deliver(events(spark, [7]), sink, 4, ("another stream", 0), pause=0)
    assert sink.got[3:] == ["T7"]


def test_rows_without_url_or_day_do_not_wait(spark, tmp_path):
    rows = spark.createDataFrame([(0, " ", "T0", 1, True), (1, None, "T1", 1, True), (2, "a", "T2", 1, False), (3, "b", "T3", 1, None), (4, " c ", "T4", 1, True), (5, "c", "T5", 9, True)], EVENT)
    at, sink = ledgers.Ledger(spark, str(tmp_path / "state")), Sink()
    assert at.deliver(None, sink, 9) == [] and at.deliver(rows, sink, 0, pause=0) == []
    assert [tuple(r)[:2] for r in at.pending().collect()] == [(4, "c")]
    assert at.deliver(rows.limit(0), sink, 9, pause=0) == [("c", "sent")] and sink.got == ["T4"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rejecting_does_not_move_the_state(spark, tmp_path):
    spark.range(20_000).select(F.concat(F.lit("u"), "id").alias("url")).write.parquet(str(tmp_path / "sent"))
    sent = spark.read.parquet(str(tmp_path / "sent"))
    some = spark.createDataFrame([("u5", 1), ("x", 2), (None, 3), ("u19999", 4), ("x", 5)], "url string, n int")
    out = reject(some, sent)
    assert sorted(r.n for r in out.collect()) == [2, 3, 5] and sorted(r.n for r in select.not_sent(some, sent).collect()) == [2, 3, 5]
    assert "Exchange hashpartitioning" not in plan(out)
    assert sorted(r.n for r in reject(some, sent, few=1).collect()) == [2, 3, 5]
    assert reject(some.limit(0), sent).count() == 0 and reject(some, sent.limit(0)).count() == 5


def test_bucketed_table_of_sent_urls(spark, tmp_path):
    at = str(tmp_path / "table")
    table = SentTable(spark, at, "sent_urls_test", buckets=4, distinct_keys=3)  # a Bloom filter far too small for its rows
    urls = spark.range(5_000).select(F.concat(F.lit("u"), "id").alias("url"))
    table.add(urls)
    table.add(urls.limit(10).unionByName(spark.createDataFrame([("new",), (None,)], "url string")))
    assert table.rows().count() == 5_001
    some = spark.range(4_990, 5_010).select(F.concat(F.lit("u"), "id").alias("url"))
    assert table.reject(some).count() == 10 and table.reject(some, few=1).count() == 10
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = table.reject(some, few=1)
        many.collect()
        final = plan(many).split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert final.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in final  # the candidates alone move
    assert sorted(r.url for r in table.holds(["u7", "zz", "new"]).collect()) == ["new", "u7"]
    table.compact()
    again = SentTable(spark, at, "sent_urls_test", buckets=4)
    assert again.rows().count() == 5_001 and files.names(spark, at) == ["v1"]
    assert len([n for n in files.names(spark, f"{at}/v1") if n.endswith("parquet")]) == 4


SEEN = "id long, t timestamp, url string"


def seen_rows(spark, rows):
    return spark.createDataFrame(rows, "id long, at string, url string").select("id", F.to_timestamp("at").alias("t"), "url")


def run_seen(spark, tmp_path, ttl="6 hours", delay="1 hour"):
    own = stateful(spark)
    source = own.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = first_seen_within(source, "t", "url", ttl, delay, "id")
    out.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).format("parquet").start(str(tmp_path / "out")).awaitTermination()
    return sorted(r.id for r in spark.read.schema(SEEN).parquet(str(tmp_path / "out")).collect())


def test_first_seen_with_expiry_late_and_unordered_rows(spark, tmp_path):
    def put(rows):
        seen_rows(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put([(2, "2026-01-01 01:00", "a"), (1, "2026-01-01 00:00", "a"), (3, "2026-01-01 00:00", "b"), (4, "2026-01-01 09:00", "a"), (5, None, "a"), (6, "2026-01-01 00:00", None)])
    assert run_seen(spark, tmp_path) == [1, 3, 4]  # 4 comes eight hours after 2
    put([(7, "2026-01-01 14:00", "a"), (8, "2026-01-01 14:00", "b"), (9, "2026-01-01 00:30", "c")])
    assert run_seen(spark, tmp_path) == [1, 3, 4, 8]  # 9 is later than the watermark of 08:00 allows, 7 continues 4
    put([(10, "2026-01-01 13:30", "b"), (11, "2026-01-01 13:10", "d"), (12, "2026-01-03 00:00", "z")])
    assert run_seen(spark, tmp_path) == [1, 3, 4, 8, 11, 12]  # out of order, but not late
    put([(13, "2026-01-03 01:00", "a"), (14, "2026-01-03 01:00", "b"), (15, "2026-01-02 12:00", "a")])
    assert run_seen(spark, tmp_path) == [1, 3, 4, 8, 11, 12, 13, 14]  # states have expired; 15 is late


def test_a_hot_key_is_folded_frame_by_frame():
    rng = random.Random(1)
    times = sorted(rng.randrange(10**7) for _ in range(3_000))
    frame = pd.DataFrame({"id": range(3_000), "at_": times})
    shuffled = frame.sample(frac=1, random_state=1)
    runs = None
    processor = _Runs(20_000, "id", ["id"])
    for i in range(0, 3_000, 100):
        runs = processor._folded(runs, shuffled[i : i + 100])
    want = [i for i in range(3_000) if i == 0 or times[i] - times[i - 1] >= 20_000]
    assert runs["id"].tolist() == want and runs["rows_"].sum() == 3_000 and len(want) > 1
