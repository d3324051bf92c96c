"""Exports: CSV lines and a person's data as one JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.text import csv_line


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One column ``line``; the header is ``columns`` joined by commas."""
    return rows.select(csv_line(*[F.col(c) for c in columns]).alias("line"))


def write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """Files of lines; the header goes into a file of its own that sorts before them."""
    spark = rows.sparkSession
    csv_lines(rows, columns).write.mode("overwrite").text(f"{path}/lines")
    spark.createDataFrame([(",".join(columns),)], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def personal_documents(users: DataFrame, **parts: DataFrame) -> DataFrame:
    """``user_id`` and ``document``: the user with a list of rows of each part. A user's own rows are bounded by what one person does."""
    out = users.select("user_id", F.struct(*users.columns).alias("profile"))
    for name, rows in parts.items():
        own = [c for c in rows.columns if c != "user_id"]
        grouped = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(*own))).alias(name))
        out = out.join(grouped, "user_id", "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    return out.select("user_id", F.to_json(F.struct("profile", *parts)).alias("document"))
