"""Streams give the same rows for any number and order of files; keyed state decides in order and is forgotten."""

import datetime as dt
import random

import pytest
from compare import connect, rows
from pyspark.sql import functions as F

from driftline.operators import ledger
from driftline.plans import QUERIES, SQL
from driftline.session import scratch_path
from driftline.streaming import streams as T

STREAMS = ["stream_tumbling", "stream_sliding", "stream_sessions", "stream_join", "stream_rate_limit", "stream_stale_runs", "stream_append_log", "stream_unique_events", "stream_upserts", "stream_tick"]


@pytest.fixture(scope="module")
def reversed_files(spark, small, tmp_path_factory):
    """The events in 24 files, the newest first, each written later than the one before."""
    import os

    import pyarrow.parquet as pq

    folder = tmp_path_factory.mktemp("reversed")
    events = pq.read_table(f"{small}/events.parquet").sort_by([("ts", "descending")])
    os.makedirs(f"{folder}/events.parquet")
    size = -(-events.num_rows // 24)
    for k in range(24):
        path = f"{folder}/events.parquet/{k:02d}.parquet"
        pq.write_table(events.slice(k * size, size), path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return str(folder)


@pytest.fixture(scope="module")
def db(small):
    return connect(small)


@pytest.mark.parametrize("name", STREAMS)
def test_files_in_any_order(spark, reversed_files, db, name):
    assert rows(QUERIES[name](spark, reversed_files).toPandas()) == rows(db.sql(SQL[name]).df())


def test_disorder_is_measured(spark, small, reversed_files):
    ordered = T.Replay(spark, f"{small}/event[s].parquet")
    assert ordered.disorder == 0 and ordered.delay == "3600 seconds"
    late = T.Replay(spark, f"{reversed_files}/event[s].parquet")
    low, high = spark.read.parquet(f"{small}/events.parquet").agg(F.min("ts"), F.max("ts")).first()
    assert 0 < late.disorder <= (high - low).total_seconds() + 1


def test_an_empty_replay(spark, small, tmp_path):
    spark.read.parquet(f"{small}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("stream_tumbling", "stream_rate_limit", "stream_stale_runs"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_limits_of_a_live_stream(spark, tmp_path):
    """Requests that come late and together are decided by time; the state of a key goes with its window."""
    schema = "event_id long, user_id long, ts timestamp"
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    out = T.limited(stream, "user_id", 2, 3600, delay="30 minutes")
    want = {}
    for batch in ([(1, 7, at(10)), (2, 7, at(5))], [(3, 7, at(4)), (4, 7, at(30)), (5, None, at(1)), (6, 7, None)], [(7, 8, at(400))], [(8, 7, at(500)), (9, 9, at(900))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = T.drained(out, "live", path=f"file://{tmp_path}/out")
        want = {r.event_id: r.allowed for r in got.collect()}
    assert want == {3: True, 2: True, 1: False, 4: False, 5: True, 7: True, 8: True}
    states = spark.read.format("statestore").option("stateVarName", "memory").load(f"file://{tmp_path}/out-checkpoint")
    assert {r.key["key"] for r in states.select("key").collect()} <= {7, 8}  # 7 opened a new window at 500, the null key's is over


def test_a_log_reads_the_prefixes_of_a_batch_only(spark):
    log = T.KeyedLog(spark, scratch_path(spark, "log"), key="k", digits=1)
    frame = lambda keys: spark.createDataFrame([(k, f"v{k}") for k in keys], "k string, v string")
    log.append(frame([None]), 0)
    assert log.read() is None
    log.append(frame([str(i) for i in range(100)] + ["5", None]), 0)
    log.append(frame(["5", "x"]), 1)
    first = sorted((r.k, r.v) for r in log.read().collect())
    assert first == sorted((k, f"v{k}") for k in [*map(str, range(100)), "x"])
    log.append(frame(["5", "x"]), 1)  # run again
    assert sorted((r.k, r.v) for r in log.read().collect()) == first
    plan = log.earlier(2, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "__prefix#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert set(r[T.PREFIX] for r in log.earlier(2, ["a", "b"]).collect()) == {"a", "b"}


def test_a_batch_changes_all_tables_or_none(spark):
    """A batch that breaks off between phases and runs again gives what an undisturbed one gives."""
    from driftline.operators.state import VersionedSet

    frame = lambda *n: spark.createDataFrame([(i,) for i in n], "n long")
    add = lambda batch, state: batch if state is None else state.unionByName(batch)
    broken = [True]

    def breaks(batch, state):
        if broken[0]:
            raise RuntimeError("killed")
        return add(batch, state)

    tables = VersionedSet(spark, scratch_path(spark, "set"), ["a", "b"])
    assert tables.read("a") is None and tables.commits() == []
    T.tick(tables, {"a": add, "b": add})(frame(1), 0)
    got = lambda: {t: sorted(r.n for r in tables.read(t).collect()) for t in ("a", "b")}
    for _ in range(2):
        with pytest.raises(RuntimeError):
            T.tick(tables, {"a": add, "b": breaks})(frame(2), 1)
        tables.tables["a"].write(frame(1, 2), 1)  # as if the first phase had been written
        assert got() == {"a": [1], "b": [1]}
    broken[0] = False
    for _ in range(2):
        T.tick(tables, {"a": add, "b": breaks})(frame(2), 1)
        assert got() == {"a": [1, 2], "b": [1, 2]} and tables.commits() == [0, 1]
    T.tick(tables, {"b": add})(frame(3), 2)
    assert got() == {"a": [1, 2], "b": [1, 2, 3]}


def plain_anonymous(requests, most, ceiling, hours, breaker):
    kept, out = [], {}
    for i, who, at in sorted(requests, key=lambda r: (r[2], r[0])):
        recent = [w for w, t in kept if t >= at - dt.timedelta(hours=breaker)]
        own = [1 for w, t in kept if w == who and t >= at - dt.timedelta(hours=hours)]
        out[i] = "CIRCUIT_OPEN" if len(recent) >= ceiling else "LIMIT_REACHED" if len(own) >= most else "RECORDED"
        if out[i] == "RECORDED":
            kept.append((who, at))
    return out


@pytest.mark.parametrize(("most", "ceiling", "addresses"), [(1, 1000, 3), (2, 3, 5), (3, 1, 50), (2, 1000, 1)])
def test_anonymous_callers_against_a_loop(spark, most, ceiling, addresses):
    rng = random.Random(most * ceiling)
    requests = [(i, f"a{rng.randrange(addresses)}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(6 * 24 * 60))) for i in range(400)]
    frame = spark.createDataFrame([(*r, "x") for r in requests] + [(999, "a", None, "x")], "request_id long, address string, created_at timestamp_ntz, outcome_of string").repartition(3)
    got = ledger.anonymous(frame, most=most, ceiling=ceiling, hours=6, breaker_hours=2)
    assert {r.request_id: r.outcome for r in got.collect()} == plain_anonymous(requests, most, ceiling, 6, 2) | {999: "CIRCUIT_OPEN"}
    assert got.columns == [*frame.columns, "outcome"]
    assert ledger.anonymous(frame.limit(0), most=1, ceiling=1).count() == 0


@pytest.mark.parametrize("made", [lambda: T._Stale(1000, "s", "e"), lambda: T._Limit(3, 1000, "at", "id")])
def test_one_timer_decides_all_that_the_watermark_has_passed(made):
    """There were a timer and a read of the whole list for each start, or 1024 requests."""
    from types import SimpleNamespace as N

    class State:
        value = None
        exists = lambda self: bool(self.value)
        get = lambda self: self.value
        appendList = lambda self, more: setattr(self, "value", (self.value or []) + more)
        put = update = lambda self, value: setattr(self, "value", value)
        clear = lambda self: setattr(self, "value", None)

    timers, it = [], made()
    it.init(N(getListState=lambda *a: State(), getValueState=lambda *a: State(), registerTimer=timers.append))
    list(it.handleInputRows((1,), iter([{"at": 5000 * i, "id": i, "kind": "s"} for i in range(3000)]), None))
    assert len(timers) == 1
    out = list(it.handleExpiredTimer((1,), N(getCurrentWatermarkInMs=lambda: 10_000), N(getExpiryTimeInMs=lambda: timers[0])))
    assert sorted(r.id for r in out) == list(range(2000)) and len(it.list.get()) == 1000
    assert len(timers) == 2
