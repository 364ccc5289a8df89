"""Sinks: CSV for spreadsheets, appends with running ids, upserts, versioned models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmart.operators.checks import insert_ignore, upsert
from quillmart.operators.storage import stored
from quillmart.sources.snapshots import Snapshots, Version


def csv_with_mark(df: DataFrame, path: str) -> None:
    """Headed CSV whose files begin with a byte order mark, as spreadsheets want it: the mark leads the first column's name."""
    first, *rest = df.columns
    df.select(F.col(f"`{first}`").alias("﻿" + first), *(F.col(f"`{c}`") for c in rest)).write.option("header", True).mode("overwrite").csv(path)


def append(df: DataFrame, path: str) -> None:
    """New files beside the old ones; the commit protocol makes the append whole or nothing."""
    df.write.mode("append").parquet(path)


def with_ids(df: DataFrame, key: str, last: int, order: list[str]) -> DataFrame:
    """``df`` with consecutive ids after ``last`` in ``order``.

    Rows are counted within range partitions and each partition's offset is added, so numbering takes no one-task
    window: only one number a partition is summed.
    """
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ordered")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    base = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_base"))
    row = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_r", row).join(F.broadcast(base), "_p").withColumn(key, F.col("_base") + F.col("_r") + F.lit(last)).drop("_p", "_r", "_base")


def append_receipts(heads: DataFrame, items: DataFrame, store: Snapshots, order: list[str]) -> DataFrame:
    """Append receipts and their items under running ids, one after the largest that is there; returns the heads with ids.

    ``heads`` and ``items`` share the column ``image``. Both tables of the store, ``receipts`` and ``items``, change in one
    version: no reader sees one without the other, and a writer that dies leaves neither.
    """
    numbered = None

    def work(at: Version):
        nonlocal numbered
        known = store.read("receipts", StructType.fromDDL("receipt long"), at)
        last = known.agg(F.max("receipt").alias("m")).first()["m"] or 0
        numbered = stored(with_ids(heads, "receipt", last, order), "receipts")
        kept = items.join(numbered.select("image", "receipt"), "image").drop("image")
        return {"receipts": ("add", numbered), "items": ("add", kept)}

    store.change(work)
    return numbered


def upsert_into(new: DataFrame, store: Snapshots, table: str, keys: list[str]) -> DataFrame:
    """The table with the new rows in place of those of their keys, as its next version; returns it read back."""
    after = store.change(lambda at: {table: ("set", upsert(store.read(table, new.schema, at), new, keys))})
    return store.read(table, new.schema, after)


def insert_new(new: DataFrame, store: Snapshots, table: str, keys: list[str]) -> int:
    """Append the rows whose key isn't in the table yet; the number appended. Delivering a batch again appends nothing."""
    n = 0

    def work(at: Version):
        nonlocal n
        base = store.read(table, new.schema, at)
        fresh = stored(insert_ignore(base.limit(0), new.join(base.select(*keys).distinct(), keys, "left_anti"), keys), "fresh")
        n = fresh.count()
        return {table: ("add", fresh)} if n else {}

    store.change(work)
    return n


def promoted(versions: DataFrame) -> DataFrame:
    """The newest version of each model that was promoted and not rolled back."""
    w = Window.partitionBy("model").orderBy(F.col("version").desc())
    return versions.where("status = 'promoted'").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
