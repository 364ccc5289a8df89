"""Token ids in Parquet list columns, written for selective reads.

One row a document, in ascending doc_id order over files named in that order: ``part, place, doc_id, n_tokens,
tokens``. Ids are dictionary-encoded (a vocabulary's ids repeat), the ascending numbers delta-encoded by the
version-2 writer; row groups and pages have set sizes and the writer keeps page indexes, so a reader of some
doc_ids, or of the token counts alone, touches those pages only. Files come from Spark's own writer and commit
protocol: a lost executor's files are written again and half-written ones are never seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmart.llm.common import text_of, tidy
from quillmart.llm.encoding import chunks

#: Bytes of a row group and a page, rows of a page at most, bytes of text a file.
ROW_GROUP, PAGE, PAGE_ROWS, PART_BYTES = 16 << 20, 256 << 10, 2_000, 64 << 20


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 1, parts: int | None = None) -> None:
    """Encode every whole text of ``docs(doc_id, text)``, append ``end_id`` and write the files below ``path``.

    Null text: empty, its end id alone. Rows are ordered by doc_id, nulls first, then by text, so repeated
    doc_ids keep a defined place; other columns are ignored. An empty table writes files without rows. ``parts``
    defaults to a file for each ``PART_BYTES`` of text, but one a core at least. Ranges are cut on (doc_id, hash of
    text), so no doc_id can fill a file alone unless its rows are equal.
    """
    coder_path = tokenizer
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n = parts or max(docs.sparkSession.sparkContext.defaultParallelism, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    # a range exchange samples its input, so the order is found on ids alone and texts move once
    ranged = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        place, coder = 0, chunks(coder_path, spaces=False)
        for b in frames:
            ids_of, part = b.column("doc_id"), b.column("part")
            for first, ids, bounds in coder.encode(x.as_py() for x in b.column("text")):
                k = len(bounds) - 1
                ends = np.arange(1, k + 1)
                full = np.insert(ids, bounds[1:], end_id).astype(np.int32)
                bounds = np.concatenate([[0], bounds[1:] + ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.slice(first, k), pa.array(np.arange(place, place + k)), ids_of.slice(first, k), pa.array(np.diff(bounds).astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(full))],
                    ["part", "place", "doc_id", "n_tokens", "tokens"],
                )
                place += k

    ranged = ranged.withColumn("part", F.spark_partition_id())
    files = (
        ranged.mapInArrow(run, "part int, place long, doc_id long, n_tokens long, tokens array<int>")
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", str(ROW_GROUP))
        .option("parquet.page.size", str(PAGE))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", "true")
        .option("parquet.dictionary.page.size", str(1 << 20))
        .option("compression", "zstd")
    )
    with tidy(docs.sparkSession):
        files.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of ``path`` with ``start``, the ids of all documents before each in file order.

    Only counts are read for the starts: each file's total, then a running sum within files. Readers that select
    no tokens never touch those pages.
    """
    files = spark.read.schema("part int, place long, doc_id long, n_tokens long, tokens array<int>").parquet(path)
    counts = files.select("part", "place", "n_tokens")
    totals = counts.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    base = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "place", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("before"))
    starts = starts.join(F.broadcast(base), "part").select("part", "place", (F.col("base") + F.col("before")).alias("start"))
    return files.join(starts, ["part", "place"])


def digests(files: DataFrame) -> DataFrame:
    """part, place and the unsigned crc32 of each document's ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column("tokens")
            ends, ids = np.asarray(c.offsets), np.asarray(c.values).astype("<u4", copy=False)
            crc = [zlib.crc32(ids[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("part", "place", "doc_id", "n_tokens")), pa.array(crc, pa.int64())], ["part", "place", "doc_id", "n_tokens", "ids_crc32"])

    return files.select("part", "place", "doc_id", "n_tokens", "tokens").mapInArrow(run, "part int, place long, doc_id long, n_tokens long, ids_crc32 long")


def digest_rows(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    docs = read(spark, path)
    starts = docs.select("part", "place", "start")
    files = spark.read.parquet(path)
    return digests(files).join(starts, ["part", "place"]).select("doc_id", "start", "n_tokens", "ids_crc32")
