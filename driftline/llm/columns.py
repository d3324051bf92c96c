"""Column helpers that several operators share; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space; every other code point belongs to a word.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; a null or blank text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_RUN))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``, lambdas included."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; of a null text that of no bytes, 0."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def running_start(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group that come before this row.

    Rows are ordered by ``bucket``, then by ``order``. No task ever holds a whole
    group: one window runs over the rows of a single (group, bucket), another over
    the bucket totals. ``bucket`` must split a group finely enough, and ``group``
    may hold nulls.
    """
    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__total"))
    base = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("__total").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"),
    )
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("__local", F.coalesce(F.sum(value).over(local), F.lit(0)))
        .join(base, same)
        .withColumn(out, (F.col("__base") + F.col("__local")).cast("long"))
        .drop("__local", "__base", *[f"__k{i}" for i in range(len(keys))])
    )


def join_counted(rows: DataFrame, known: DataFrame, on: list[str], weight: str, total: int, share: int = 1000) -> DataFrame:
    """Join to each row the one row of ``known`` with its key, of which ``weight`` says how many rows have it; null keys are equal.

    A key that more than one in ``share`` of the ``total`` rows have would burden one
    task. There are fewer than ``share`` such keys: they are broadcast, and only the
    other rows are shuffled.
    """
    least = total // share + 1
    new = [c for c in known.columns if c not in on]
    renamed = known.select(*[F.col(c).alias(f"__on_{c}") for c in on], *new)
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__on_{c}"))
    keys = [f"__on_{c}" for c in on]
    hot = rows.join(F.broadcast(renamed.where(F.col(weight) >= least)), same, "inner").drop(*keys)
    named = renamed.where(F.col(weight) >= least).select(*keys)
    rest = rows.join(F.broadcast(named), same, "left_anti").join(renamed.where(F.col(weight) < least).hint("merge"), same).drop(*keys)
    return hot.unionByName(rest)
