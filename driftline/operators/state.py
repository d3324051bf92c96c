"""Keyed state on Parquet: merge into a new version, then move the pointer."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge(state: DataFrame, upserts: DataFrame, keys: list[str], keep: tuple[str, ...] = (), fill: tuple[str, ...] = (), when_active: tuple[str, ...] = (), status: str = "status", order: tuple[str, ...] = (), newest: str | None = None) -> DataFrame:
    """Insert or update rows of ``state`` by ``keys``, with the columns of ``state``.

    ``keep``: columns that a known row never changes (its id, its first sighting);
    ``fill``: columns whose old value stays where the new one is null;
    ``when_active``: columns that change only if the new status is ACTIVE. Of
    repeated upserts of a key the last by ``order`` counts (by all other columns if
    there is none), so that a rerun takes the same one. ``newest``: a column by which an
    upsert that is older than the known row changes nothing.
    """
    new = last_of(upserts, keys, order).select(*keys, F.lit(True).alias("__new"), *[F.col(c).alias(f"__n_{c}") for c in upserts.columns if c not in keys])
    rows = state.withColumn("__old", F.lit(True)).join(new, keys, "full_outer")

    def merged(c: str) -> Column:
        fresh = F.col(f"__n_{c}")
        if c in keep:
            return F.when(F.col("__old"), F.col(c)).otherwise(fresh)
        if c in fill:
            return F.coalesce(fresh, F.col(c))
        takes = F.col("__new")
        if newest:
            takes = takes & (F.col(newest).isNull() | (F.col(f"__n_{newest}") >= F.col(newest)))
        if c in when_active:
            takes = takes & (F.col("__old").isNull() | (F.col(f"__n_{status}") == "ACTIVE"))
        return F.when(takes, fresh).otherwise(F.col(c))

    return rows.select(*[F.col(c) if c in keys else (merged(c) if c in upserts.columns else F.col(c)).alias(c) for c in state.columns])


def insert_missing(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` and those rows whose keys it lacks, once each: the last by all other columns."""
    fresh = last_of(rows, keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def last_of(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """One row of each key, the last by ``order`` and then by all other columns that can be ordered; equal rows are alike."""
    others = [f.name for f in rows.schema if f.name not in (*keys, *order) and "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    best = F.max_by(F.struct(*[F.col(c) for c in rows.columns if c not in keys]), F.struct(*order, *others)) if len(rows.columns) > len(keys) and (order or others) else None
    if best is None:
        return rows.dropDuplicates(keys)
    made = rows.groupBy(*keys).agg(best.alias("__best"))
    return made.select(*[F.col(c) if c in keys else F.col("__best")[c].alias(c) for c in rows.columns])


def purge(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't in ``gone``: what a cascading delete leaves."""
    return rows.join(gone.select(*keys), keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def bag_hash(text: Column) -> Column:
    """An aggregate: a hash of the bag of texts, whatever their order. Null texts aren't in the bag.

    It is their number and the sums of two parts of 60 bits of their SHA-256, so that
    tasks add up what they have and only sums are shuffled.
    """
    digest = F.sha2(text, 256)
    sums = [F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")).cast("string") for at in (1, 16)]
    return F.concat_ws("-", F.count(text).cast("string"), *sums)


def content_hashes(rows: DataFrame, keys: list[str], **texts: Column) -> DataFrame:
    """``keys`` and a ``bag_hash`` under each name; equal hashes mean equal content. Where order counts, a text says its row's place."""
    return rows.groupBy(*keys).agg(*[bag_hash(t).alias(name) for name, t in texts.items()])


def list_hashes(rows: DataFrame, keys: list[str], block: Column, order: Column, text: str) -> DataFrame:
    """``keys`` and ``hash``, the SHA-256 of ``[..]`` around a key's texts in ``order``, with commas between them.

    Rows of one ``block``, which never falls as ``order`` rises, are joined first, so that rows are collected in small groups
    and a key's last step holds nothing but its text in pieces. A SHA-256 has to see that text whole.
    """
    joined = lambda place, what: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("place"), F.col(what).alias("t")))), lambda x: x["t"]), ",")
    pieces = rows.groupBy(*keys, block.alias("__block")).agg(joined(order, text).alias("__piece"))
    return pieces.groupBy(*keys).agg(F.sha2(F.concat(F.lit("["), joined(F.col("__block"), "__piece"), F.lit("]")), 256).alias("hash"))


class VersionedTable:
    """A table of which each version is a folder ``v=<n>`` (or another ``label``); readers see the last complete one.

    A version is complete once its writer has left ``_SUCCESS``, so that readers
    never see half a version. Writing a version again replaces it, which makes a
    batch that is run twice harmless.
    """

    def __init__(self, spark: SparkSession, path: str, label: str = "v"):
        self.spark, self.path, self.label = spark, path.rstrip("/"), label

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        found = [(re.fullmatch(rf"{self.label}=(\d+)", s.getPath().getName()), s.getPath()) for s in fs.listStatus(path)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(m[1]) for m, p in found if m and fs.exists(done(p, "_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame | None:
        known = self.versions()
        if not known:
            return None
        return self.spark.read.parquet(f"{self.path}/{self.label}={known[-1] if version is None else version}")

    def write(self, rows: DataFrame, version: int | None = None) -> int:
        known = self.versions()
        at = (known[-1] + 1 if known else 0) if version is None else version
        rows.write.mode("overwrite").parquet(f"{self.path}/{self.label}={at}")
        return at

    def vacuum(self, keep: int = 2) -> None:
        fs, path = self._fs()
        for v in self.versions()[:-keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"{self.label}={v}"), True)


class VersionedSet:
    """Several tables that change together.

    A batch writes a version of each table that it changes and then one commit, which
    names the version of every table. Readers go by the newest commit, so that they see
    all of a batch or nothing of it. A batch begins with the commit before its own
    number, whatever a broken run of it has left, so that running it again repeats all phases.
    """

    def __init__(self, spark: SparkSession, path: str, tables: list[str]):
        self.spark, self.path = spark, path.rstrip("/")
        self.tables = {t: VersionedTable(spark, f"{self.path}/{t}") for t in tables}

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def commits(self) -> list[int]:
        fs, folder = self._file("x")
        folder = folder.getParent()
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit())

    def versions(self, before: int | None = None) -> dict[str, int]:
        """The version of each table at the newest commit (before a number)."""
        known = [c for c in self.commits() if before is None or c < before]
        if not known:
            return {}
        return {r.table: r.version for r in self.spark.read.json(self._file(str(known[-1]))[1].toString(), schema="table string, version int").collect()}

    def read(self, table: str, before: int | None = None) -> DataFrame | None:
        at = self.versions(before).get(table)
        return None if at is None else self.tables[table].read(at)

    def commit(self, batch_id: int, changed: dict[str, DataFrame]) -> None:
        """Write the tables that the batch changes, in order, and then its commit."""
        versions = self.versions(before=batch_id)
        for name, rows in changed.items():
            self.tables[name].write(rows, batch_id)
            versions[name] = batch_id
        fs, path = self._file(str(batch_id))
        lines = "".join(f'{{"table": "{t}", "version": {v}}}\n' for t, v in sorted(versions.items()))
        part = self._file(f"_{batch_id}")[1]
        out = fs.create(part, True)
        out.write(bytearray(lines.encode()))
        out.close()
        fs.delete(path, False)
        fs.rename(part, path)  # at once
