"""What a stream costs in accesses to its state, and the rows that Spark gives and takes."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import Row

from sonorel.streaming import extractors as E
from tests.test_extension import Count, Map, Store, Value, pusher


class Trips(Store):
    """Counts accesses: each is a round trip between processes."""

    def __init__(self):
        super().__init__()
        self.n = 0

    def _counting(self, state, names):
        for name in names:
            f = getattr(state, name)

            def call(*args, f=f):
                self.n += 1
                return f(*args)

            setattr(state, name, call)
        return state

    def getValueState(self, name, schema):
        return self.states.setdefault(name, self._counting(Value(), ("exists", "get", "update", "clear")))

    def getMapState(self, name, key_schema, value_schema):
        return self.states.setdefault(name, self._counting(Map(), ("containsKey", "getValue", "updateValue", "removeKey", "clear")))


def test_a_batch_of_a_stream_takes_few_trips():
    store, p = Trips(), E.HashProcessor(Count)
    p.init(store)
    push = pusher(p, store)
    assert push((3, 1, False), (1, 1, False)) == [] and store.n <= 3
    store.n = 0
    assert push((1, 2, False), (4, 1, False)) == [] and store.n <= 2
    store.n = 0
    assert push((0, 1, False), (2, 1, False), (5, 1, True)) == [1, 2, 3, 4, 5, 6, -1] and store.n <= 3


@pytest.mark.parametrize("sizes", [[1] * 40, [30_000] * 3])
def test_many_or_long_chunks_wait_under_keys_of_their_own(sizes):
    store, p = Store(), E.HashProcessor(Count)
    p.init(store)
    push = pusher(p, store)
    assert push((1, 1, False)) == [] and not store.states["early"]
    assert push(*[(k + 2, n, False) for k, n in enumerate(sizes)]) == [] and len(store.states["early"]) == len(sizes) + 1
    assert push((0, 1, False)) == list(range(1, len(sizes) + 3)) and not store.states["early"]


class Numbered(Count):
    def push(self, samples):
        return [(2.0, *super().push(samples)[0][1:3])]


def test_rows_in_and_out():
    store, p = Store(), E.HashRows(Numbered, patience_ms=500, event_time="at")
    p.init(store)
    when = datetime(2024, 1, 1, tzinfo=timezone.utc)
    chunk = Row("stream_id", "seq", "samples", "eos", "at")
    got = list(p.handleInputRows(("s",), iter([chunk("s", 1, None, True, when), chunk("s", 0, [1.0, None], False, when.replace(tzinfo=None))]), store))
    assert [tuple(r) for r in got] == [("s", 2, 2, 0, None, None, None), ("s", -1, 1, 0, None, None, None)] and type(got[0].t_ms) is int
    assert store.timers == [1000 * int(when.timestamp()) + 500]
    with pytest.raises(ValueError):
        E._whole(2.5)
