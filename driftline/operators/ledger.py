"""Ledgers in which each decision depends on the decisions before it.

A refused request uses up nothing, so that no window over the requests can tell
what was accepted. Requests are brought together by their key and sorted by time;
a small loop decides them in turn, batch by batch, and carries no more from one to
the next than the current key's state, however many requests a key has.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import count
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.session import written


def _decided(requests: DataFrame, key: str, order: list[str], start: Callable[[], Callable[..., Any]], reads: list[str], result: str) -> DataFrame:
    """``start`` begins a key and returns what decides its requests in turn, from the columns ``reads``."""
    columns = [f for f in requests.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + f", {result}"
    name, kind = result.split()
    out_type = {"string": pa.string(), "boolean": pa.bool_()}[kind]

    def values(column: pa.Array) -> Any:
        return column.to_pandas() if pa.types.is_timestamp(column.type) else column.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, decide = object(), None
        for batch in batches:
            out = []
            for this, *row in zip(*(values(batch.column(c)) for c in [key, *reads]), strict=True):
                if decide is None or this != last:
                    last, decide = this, start()
                out.append(decide(*row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, out_type)], names=[*batch.schema.names, name])

    ordered = requests.repartition(key).sortWithinPartitions(key, *[F.col(c).asc_nulls_last() for c in order])
    return ordered.mapInArrow(run, schema)


def quota(requests: DataFrame, key: str = "user_id", limit: str = "quota", hours: int = 24, at: str = "created_at", store: str = "store_id", tie: str = "request_id") -> DataFrame:
    """Add ``outcome`` to analysis requests: ALLOWED, REPEATED (a store analysed in the window is free) or REFUSED.

    A null quota is unlimited. Each key's requests are decided on their own; its state is the uses in the window.
    """
    span = pd.Timedelta(hours=hours)

    def start() -> Callable[..., str]:
        used: deque = deque()
        held: set = set()  # the stores in it, each once

        def decide(now: pd.Timestamp, most: int | None, what: Any) -> str:
            while used and used[0][0] <= now - span:
                held.discard(used.popleft()[1])
            if what in held:
                return "REPEATED"
            if pd.isna(most) or len(used) < most:
                used.append((now, what))
                held.add(what)
                return "ALLOWED"
            return "REFUSED"

        return decide

    return _decided(requests, key, [at, tie], start, [at, limit, store], "outcome string")


def rate_limit(requests: DataFrame, key: str, limit: int, seconds: int, at: str = "created_at", tie: str = "request_id") -> DataFrame:
    """Add ``allowed``: a window opens at a key's first request and lasts ``seconds``; the next opens at the first request after it."""
    span = pd.Timedelta(seconds=seconds)

    def start() -> Callable[..., bool]:
        begun, n = None, 0

        def decide(now: pd.Timestamp) -> bool:
            nonlocal begun, n
            if begun is None or now >= begun + span:
                begun, n = now, 0
            n += 1
            return n <= limit

        return decide

    return _decided(requests, key, [at, tie], start, [at], "allowed boolean")


def anonymous(requests: DataFrame, most: int, ceiling: int, key: str = "address", hours: int = 24, breaker_hours: int = 1, at: str = "created_at", tie: str = "request_id", rounds: int | None = None) -> DataFrame:
    """Add ``outcome`` to requests of anonymous callers: RECORDED, LIMIT_REACHED or CIRCUIT_OPEN.

    If ``ceiling`` requests of all callers were recorded in the last ``breaker_hours``, the
    circuit is open; else if ``most`` of the caller's were in the last ``hours``, its limit is
    reached. What is refused isn't recorded. A request at the very beginning of a window counts.
    The result is that of one loop over all requests by time, then ``tie``.

    Time is cut into slices of ``hours``, which are decided side by side. What a slice
    has to know of those before it is what the last one recorded, at most ``ceiling`` for
    each ``breaker_hours``. At first each believes that this is nothing; a slice
    whose predecessor recorded something else than it believed is decided again, until none is. The first slice is
    right at once and each round makes at least one more right, mostly all but those behind an open circuit.
    A slice is read batch by batch; its state is what the window holds. ``rounds`` may bound the rounds (an error
    if they don't suffice). Requests without a time are refused as CIRCUIT_OPEN.
    """
    span, short = hours * 3_600_000_000, breaker_hours * 3_600_000_000
    rows = requests.withColumn("__at", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("__slice", F.expr(f"floor(__at / {span})"))
    rows = written(rows.withColumns({"__key": F.col(key).cast("string"), "__tie": F.col(tie).cast("long")}), "anonymous-requests")
    core = [F.col("__slice"), F.col("__at"), F.col("__tie"), F.col("__key"), F.lit(False).alias("__before")]
    timed = rows.where(F.col("__at").isNotNull())
    light = timed.select(*core)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, window, recent, own = None, deque(), deque(), {}
        for batch in batches:
            out = []
            for part, now, _, who, before in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                if part != last:
                    last, window, recent, own = part, deque(), deque(), {}
                while window and window[0][0] < now - span:
                    _, gone = window.popleft()
                    own[gone] -= 1
                    if not own[gone]:
                        del own[gone]
                while recent and recent[0] < now - short:
                    recent.popleft()
                verdict = "RECORDED"
                if not before:
                    verdict = "CIRCUIT_OPEN" if len(recent) >= ceiling else "LIMIT_REACHED" if own.get(who, 0) >= most else "RECORDED"
                if verdict == "RECORDED":
                    window.append((now, who))
                    recent.append(now)
                    own[who] = own.get(who, 0) + 1
                out.append(verdict)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "outcome"])

    def decided(some: DataFrame, recorded: DataFrame | None) -> DataFrame:
        if recorded is not None:
            some = some.unionByName(recorded.select((F.col("__slice") + 1).alias("__slice"), "__at", "__tie", "__key", F.lit(True).alias("__before")), allowMissingColumns=True)
        ordered = some.repartition("__slice").sortWithinPartitions("__slice", "__at", "__tie", F.desc("__before"))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields)
        return ordered.mapInArrow(run, f"{kinds}, outcome string").where(~F.col("__before"))

    recorded = written(decided(light, None).where("outcome = 'RECORDED'").drop("outcome"), "recorded")
    told, done = None, 0
    while True:
        mark = recorded.groupBy("__slice").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("__at", "__tie", "__key").cast("decimal(20,0)")).alias("sum"))
        mark = written(mark, "recorded-marks")
        fresh = mark if told is None else mark.join(told.withColumnRenamed("n", "m").withColumnRenamed("sum", "was"), "__slice", "left").where(~(F.col("n").eqNullSafe(F.col("m")) & F.col("sum").eqNullSafe(F.col("was")))).select("__slice")
        gone = None if told is None else told.join(mark, "__slice", "left_anti").select("__slice")
        stale = fresh.select("__slice") if gone is None else fresh.select("__slice").unionByName(gone)
        # slices that haven't been told what the one before them recorded
        again = light.join(stale.select((F.col("__slice") + 1).alias("__slice")), "__slice", "left_semi")
        if again.isEmpty():
            break
        if done == rounds:
            raise ValueError(f"not settled after {rounds} rounds")
        done += 1
        redone = written(again.select("__slice").distinct(), "slices-again")
        here = recorded.join(redone.select((F.col("__slice") - 1).alias("__slice")), "__slice", "left_semi")
        better = decided(again, here).where("outcome = 'RECORDED'").drop("outcome")
        recorded, told = written(recorded.join(redone, "__slice", "left_anti").unionByName(better), "recorded"), mark
    columns = requests.columns
    untimed = rows.where(F.col("__at").isNull()).select(*columns, F.lit("CIRCUIT_OPEN").alias("outcome"))
    return decided(timed.select(*core, *columns), recorded).select(*columns, "outcome").unionByName(untimed)


def slots(requests: DataFrame, key: str = "user_id", limit: str = "slots", at: str = "created_at", until: str = "expires_at", store: str = "store_id", tie: str = "request_id") -> DataFrame:
    """Add ``outcome`` to requests to watch a store: STARTED, ALREADY_ACTIVE or NO_SLOT; a watch holds its slot until it expires."""

    def start() -> Callable[..., str]:
        active: set = set()
        ends: list = []  # a heap of the watches that end, by their end
        number = count()

        def decide(now: pd.Timestamp, end: pd.Timestamp, most: int | None, what: Any) -> str:
            while ends and ends[0][0] <= now:
                active.discard(heappop(ends)[2])
            if what in active:
                return "ALREADY_ACTIVE"
            if pd.isna(most) or len(active) < most:
                active.add(what)
                if not pd.isna(end):
                    heappush(ends, (end, next(number), what))
                return "STARTED"
            return "NO_SLOT"

        return decide

    return _decided(requests, key, [at, tie], start, [at, until, limit, store], "outcome string")


def promo_verdict(promo: dict[str, Column], user_id: Column, plan: Column, now: Column) -> Column:
    """Why a code can't be used, or ok; the rules are tried in this order."""
    return (
        F.when(promo["code"].isNull(), "not_found")
        .when(promo["assigned_to"].isNotNull() & (promo["assigned_to"] != user_id), "not_assigned_to_you")
        .when(promo["status"] != "ACTIVE", "disabled")
        .when(now < promo["valid_from"], "not_yet_valid")
        .when(now > promo["valid_until"], "expired")
        .when(promo["plan"].isNotNull() & (promo["plan"] != plan), "wrong_plan")
        .when(promo["redemptions"] >= promo["max_redemptions"], "exhausted")
        .when(promo["user_redemptions"] >= promo["per_user_limit"], "already_redeemed")
        .otherwise("ok")
    )


def discounted(price: Column, percent: Column, amount: Column) -> Column:
    """A price after a percentage, rounded down, or an amount off; never below 0."""
    off = F.when(percent.isNotNull(), F.floor(price * percent / 100)).otherwise(F.coalesce(amount, F.lit(0)))
    return F.greatest(F.lit(0), price - F.least(off, price)).cast("long")


def redemptions(requests: DataFrame, at: str = "created_at", tie: str = "request_id", minutes: int = 60) -> DataFrame:
    """Add ``redeemed`` to requests (promo, user_id, max_redemptions): first come, a user once, until the code is used up.

    A user's first request decides alone, so that this needs no loop. How many came before it
    is counted in slices of ``minutes``, whose totals are summed up apart: no task holds all requests of a code.
    """
    mine = Window.partitionBy("promo", "user_id").orderBy(at, tie)
    rows = requests.withColumn("__first", (F.row_number().over(mine) == 1).cast("long"))
    rows = rows.withColumn("__slice", F.expr(f"floor(unix_micros(cast(`{at}` AS timestamp)) / {minutes * 60_000_000})"))
    totals = rows.groupBy("promo", "__slice").agg(F.sum("__first").alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(Window.partitionBy("promo").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.select(F.col("promo").alias("__promo"), F.col("__slice").alias("__of"), earlier.alias("__base"))
    inside = F.sum("__first").over(Window.partitionBy("promo", "__slice").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0))
    counted = rows.withColumn("__n", inside).join(base, F.col("promo").eqNullSafe(F.col("__promo")) & F.col("__slice").eqNullSafe(F.col("__of")))
    redeemed = (F.col("__first") == 1) & (F.col("max_redemptions").isNull() | (F.col("__base") + F.col("__n") <= F.col("max_redemptions")))
    return counted.withColumn("redeemed", redeemed).select(*requests.columns, "redeemed")


def promo_listing(promos: DataFrame, redeemed: DataFrame) -> DataFrame:
    """Codes with the number of their redemptions, users and what is left of them (null: no bound); codes that nobody used are listed too."""
    used = redeemed.groupBy("promo").agg(F.count(F.lit(1)).alias("redemptions"), F.count_distinct("user_id").alias("users"))
    rows = promos.join(used, "promo", "left").na.fill(0, ["redemptions", "users"])
    left = F.col("max_redemptions") - F.col("redemptions")
    return rows.withColumn("left", F.when(left > 0, left).when(left <= 0, F.lit(0)))
