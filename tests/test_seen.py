"""The processor of first-seen rows by itself: what it asks the state store, and hot keys against plain ones."""

import random

from pyspark.sql import Row

from eventloom.streaming import seen


class Store:
    """A handle and its value state that note every call."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), []

    def getValueState(self, *_):  # noqa: N802
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def listTimers(self):  # noqa: N802
        self.calls.append("listTimers")
        return iter(self.timers)

    def registerTimer(self, at):  # noqa: N802
        self.calls.append("registerTimer")
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls.append("deleteTimer")
        self.timers.remove(at)


def processor(store):
    out = seen._Runs(20_000, "id", {"id": "id"})
    out.init(store)
    return out


def test_a_key_asks_the_state_store_four_times_at_most():
    store = Store()
    of = processor(store)
    assert [r.id for r in of.handleInputRows(("a",), iter([Row(id=2, at_=1_000), Row(id=1, at_=1_000)]), None)] == [1]
    assert store.calls == ["get", "registerTimer", "update"] and store.value == (1_000, 1_000, 2)
    store.calls.clear()
    assert [r.id for r in of.handleInputRows(("a",), iter([Row(id=3, at_=15_000), Row(id=4, at_=90_000)]), None)] == [4]
    assert store.calls == ["get", "deleteTimer", "registerTimer", "update"] and store.timers == {111}
    store.calls.clear()
    assert list(of.handleInputRows(("a",), iter([Row(id=5, at_=90_000)]), None)) == []
    assert store.calls == ["get", "update"] and store.value == (90_000, 90_000, 2)


def test_a_hot_key_gives_what_a_plain_one_gives(monkeypatch):
    rng = random.Random(2)
    rows = [Row(id=i, at_=rng.randrange(10**7)) for i in range(3_000)]
    got = []
    for frame in (100, 10_000):
        monkeypatch.setattr(seen, "FRAME", frame)
        store = Store()
        got.append(([r.id for r in processor(store).handleInputRows(("a",), iter(rows), None)], store.value, store.timers))
    assert got[0] == got[1] and len(got[0][0]) > 1
