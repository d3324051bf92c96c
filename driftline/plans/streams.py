"""Streaming queries over the events, drained to the end.

Windows that the last watermark doesn't close stay open, as in any stream; these
queries report those that end an hour before the newest event, so that SQL can tell
them too. The files may come in any order and number: see ``Replay``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.state import VersionedSet, VersionedTable
from driftline.plans.registry import query
from driftline.session import scratch_path, table
from driftline.streaming import streams as T


def _path(sf: str) -> str:
    return f"{sf.rstrip('/')}/event[s].parquet"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return T.event_stream(spark, _path(sf))


_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("stream_unique_events", "SELECT user_id, event_type, count(DISTINCT props) AS n FROM events GROUP BY ALL")
def stream_unique_events(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props")
    stream = T.unique_events(_events(spark, sf).withColumn("dedupe_key", key), delay="60 days")
    return T.drained(stream.select("user_id", "event_type", "props", "dedupe_key"), "unique").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_tumbling",
    f"""WITH w AS (SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type, value FROM events)
        SELECT start, start + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, max(value) AS largest FROM w GROUP BY start, event_type HAVING start + INTERVAL 1 HOUR <= {_CLOSED}""",
)
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    replay = T.Replay(spark, _path(sf))
    return T.ntz(replay.drained(T.tumbling(replay.stream(), delay=replay.delay), "tumbling"), "start", "end")


@query(
    "stream_sliding",
    f"""WITH w AS (SELECT event_type, CAST(time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k::INTEGER) AS TIMESTAMP) AS start FROM events, range(6) r(k))
        SELECT start, start + INTERVAL 6 HOUR AS "end", event_type, count(*) AS n FROM w GROUP BY ALL HAVING start + INTERVAL 6 HOUR <= {_CLOSED}""",
)
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    replay = T.Replay(spark, _path(sf))
    return T.ntz(replay.drained(T.sliding(replay.stream(), delay=replay.delay), "sliding"), "start", "end")


@query(
    "stream_sessions",
    f"""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
        b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM b GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}""",
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    replay = T.Replay(spark, _path(sf))
    return T.ntz(replay.drained(T.sessions(replay.stream(), delay=replay.delay), "sessions"), "start", "end")


@query("stream_join", "SELECT s.user_id, s.event_id AS signup_id, p.event_id AS purchase_id FROM events s JOIN events p ON s.user_id = p.user_id AND s.event_type = 'signup' AND p.event_type = 'purchase' AND p.ts >= s.ts AND p.ts <= s.ts + INTERVAL 1 DAY")
def stream_join(spark: SparkSession, sf: str) -> DataFrame:
    replay = T.Replay(spark, _path(sf))
    return replay.drained(T.signups_then_purchases(replay.stream(), delay=replay.delay), "joined")


@query("stream_upserts", "SELECT user_id, arg_max(event_id, event_id) AS event_id FROM events GROUP BY user_id")
def stream_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """The newest event of each user, kept as a versioned table that batches are merged into."""
    target = VersionedTable(spark, scratch_path(spark, "last-event"))
    sink = T.upsert_sink(target, ["user_id"], newest="event_id")
    T.drained_each(_events(spark, sf), "upserts", lambda batch, n: sink(batch.groupBy("user_id").agg(F.max("event_id").alias("event_id")), n))
    return target.read()


@query(
    "stream_tick",
    """SELECT 'last' AS part, user_id AS key, max(event_id) AS value FROM events GROUP BY user_id UNION ALL SELECT 'visits', user_id, count(*) FROM events GROUP BY user_id
       UNION ALL SELECT 'open', s.user_id, max(s.event_id) FROM events s WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = s.user_id AND p.event_type = 'purchase') GROUP BY s.user_id""",
)
def stream_tick(spark: SparkSession, sf: str) -> DataFrame:
    """Three tables that each batch of events changes together: the last event and the visits of users, and the sign-ups of those that never bought."""
    tables = VersionedSet(spark, scratch_path(spark, "tick"), ["last", "visits", "open"])
    either = lambda state, rows: rows if state is None else state.unionByName(rows)
    best = lambda df: df.groupBy("user_id").agg(F.max("value").alias("value"))
    phases = {
        "last": lambda batch, state: best(either(state, batch.select("user_id", F.col("event_id").alias("value")))),
        "visits": lambda batch, state: either(state, batch.select("user_id", F.lit(1).cast("long").alias("value"))).groupBy("user_id").agg(F.sum("value").alias("value")),
        "open": lambda batch, state: either(state, batch.where("event_type IN ('signup', 'purchase')").select("user_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("value"), (F.col("event_type") == "purchase").alias("bought")))
        .groupBy("user_id")
        .agg(F.max("value").alias("value"), F.bool_or("bought").alias("bought")),
    }
    T.drained_each(_events(spark, sf), "tick", T.tick(tables, phases))
    shown = lambda name, df: df.where("value IS NOT NULL").select(F.lit(name).alias("part"), F.col("user_id").alias("key"), "value")
    return shown("last", tables.read("last")).unionByName(shown("visits", tables.read("visits"))).unionByName(shown("open", tables.read("open").where("NOT bought")))


_LIMIT = """WITH RECURSIVE r AS (SELECT {id} AS id, user_id, {at} AS t, row_number() OVER (PARTITION BY user_id ORDER BY {at}, {id}) AS place FROM events {where}),
    d AS (SELECT id, user_id, place, t AS begun, 1 AS n FROM r WHERE place = 1
          UNION ALL SELECT r.id, r.user_id, r.place, CASE WHEN r.t >= d.begun + INTERVAL 6 HOUR THEN r.t ELSE d.begun END, CASE WHEN r.t >= d.begun + INTERVAL 6 HOUR THEN 1 ELSE d.n + 1 END
          FROM d JOIN r ON r.user_id = d.user_id AND r.place = d.place + 1)"""


@query("stream_rate_limit", _LIMIT.format(id="event_id", at="ts", where="") + " SELECT id AS event_id, user_id, n <= 3 AS allowed FROM d")
def stream_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Which requests a limit of 3 in 6 hours per user lets through."""
    replay = T.Replay(spark, _path(sf), beyond=1)
    return replay.drained(T.limited(replay.stream(), "user_id", 3, 21_600, delay=replay.delay), "limited")


@query(
    "stream_stale_runs",
    f"""SELECT user_id, event_id, ts AS started, ts + INTERVAL 1 DAY AS deadline FROM events s WHERE event_type = 'signup' AND ts + INTERVAL 1 DAY < {_CLOSED}
        AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = s.user_id AND p.event_type = 'purchase' AND p.ts >= s.ts AND p.ts <= s.ts + INTERVAL 1 DAY)""",
)
def stream_stale_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-ups that no purchase has followed within a day, told when the day is over though nothing has come."""
    replay = T.Replay(spark, _path(sf))
    rows = replay.drained(T.stale_runs(replay.stream(), "user_id", "event_type", "signup", "purchase", 86_400, delay=replay.delay), "stale")
    return T.ntz(rows, "started", "deadline")


@query("stream_append_log", "SELECT user_id, event_type, props FROM events WHERE user_id IS NOT NULL GROUP BY ALL")
def stream_append_log(spark: SparkSession, sf: str) -> DataFrame:
    """Each kind of event of a user once, whatever the time between its repetitions."""
    log = T.KeyedLog(spark, scratch_path(spark, "log"))
    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props")
    T.drained_each(_events(spark, sf).select("user_id", "event_type", "props", key.alias("dedupe_key")), "append", log.append)
    return log.read().drop("dedupe_key")


@query("batch_sessions", "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) SELECT user_id, CAST(sum(fresh) AS BIGINT) AS sessions, count(*) AS events FROM a GROUP BY user_id")
def batch_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))
