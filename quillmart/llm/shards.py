"""Size-tiered compaction of immutable shards under a versioned manifest, in DataFrame operations only.

A store is a folder with ``data/<run>/`` (one Parquet run of shards each, never changed) and ``manifest/`` (one row a
live run and version). An arrival is written as a small run and committed; when ``fan_in`` runs stand in one size
tier they are read, merged and written as one run of target-sized files, and a new version replaces them. Tiers are
powers of ``fan_in`` of the smallest run size, so a row is rewritten once a tier: as often as the logarithm of the
number of arrivals.

A version's rows are one Parquet file under a token of their own; then the version is claimed: a small file that
holds the token gets the version's number as its name, in one step that fails where that name exists (a rename that
doesn't overwrite, on a local disk a link). So of all writers of a version exactly one wins, the others are told and
must try again, and what a version holds never changes. A run that fails before leaves only files that no version
names. Only run names and sizes, in proportion to the number of live runs, reach the driver. On object stores without
such a rename the claim needs a store that has one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.llm.common import free_name, tidy

_MANIFEST = "version long, token string, run string, n_rows long, n_bytes long, n_shards long"


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Run:
    run: str
    n_rows: int
    n_bytes: int
    n_shards: int


class Store:
    """A shard store at ``path``.

    ``size`` names the column or expression whose sum is a run's size in bytes; ``target_bytes`` the size of a
    compacted shard by it; runs below ``least_bytes`` share the lowest tier; ``fan_in`` runs of a tier are merged.
    """

    def __init__(self, spark: SparkSession, path: str, *, size: str = "octet_length(coalesce(text, ''))", target_bytes: int = 128 << 20, least_bytes: int = 1 << 20, fan_in: int = 4):
        self.spark, self.path, self.size = spark, path.rstrip("/"), size
        self.target_bytes, self.least_bytes, self.fan_in = target_bytes, least_bytes, fan_in

    def _hadoop(self, name: str = ""):
        """A path of Hadoop's and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, files = self._hadoop(folder)
        return sorted(x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else []

    def _claimed(self, version: int) -> str:
        """The token of a version."""
        return self.spark.read.text(f"{self.path}/versions/{version:012d}").first()[0]

    def _claim(self, version: int, token: str) -> None:
        """Give the version to the token, or raise ``Conflict``."""
        to, files = self._hadoop(f"versions/{version:012d}")
        files.mkdirs(to.getParent())
        held, _ = self._hadoop(f"versions/.{token}")
        out = files.create(held, False)
        out.write(bytearray(token, "ascii"))
        out.close()
        try:
            if files.getUri().getScheme() == "file":
                os.link(held.toUri().getPath(), to.toUri().getPath())
                won = True
            else:
                won = files.rename(held, to)
        except FileExistsError:
            won = False
        if files.exists(held):
            files.delete(held, False)
        if not won:
            raise Conflict(f"version {version} of {self.path} was committed by another writer")

    def manifest(self, version: int | None = None) -> tuple[int, list[Run]]:
        """The newest version, or ``version``, and its runs; (0, []) before the first commit."""
        known = [int(x) for x in self._names("versions") if x.isdigit()]
        if version is not None:
            known = [v for v in known if v == version]
        if not known:
            return 0, []
        newest = max(known)
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/{self._claimed(newest)}")
        return newest, sorted((Run(r.run, r.n_rows, r.n_bytes, r.n_shards) for r in rows.collect() if r.run is not None), key=lambda r: r.run)

    def commit(self, version: int, runs: list[Run]) -> None:
        """Write the whole version as one file and claim it; a version without runs has one row without a run."""
        token = uuid.uuid4().hex
        rows = [(version, token, r.run, r.n_rows, r.n_bytes, r.n_shards) for r in runs] or [(version, token, None, 0, 0, 0)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/{token}")
        self._claim(version, token)

    def _write(self, rows: DataFrame, shards: int, level: int) -> Run:
        name = f"{level:02d}-{uuid.uuid4().hex}"
        if shards:
            # rows are dealt evenly whatever their keys, so a hot source can't fill one shard
            rows = rows.repartition(shards)
        with tidy(self.spark):
            rows.write.option("compression", "zstd").parquet(f"{self.path}/data/{name}")
        return self._measured(name)

    def _measured(self, name: str) -> Run:
        got = self._run(name).select(F.expr(self.size).alias("b"), F.col("_metadata.file_path").alias("f"))
        got = got.agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.count_distinct("f").alias("f")).first()
        return Run(name, got["n"], got["b"], got["f"])

    def _run(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/{name}")

    def append(self, rows: DataFrame) -> int:
        """Write ``rows`` as a new run, as small shards as they come, and commit; returns the new version."""
        version, runs = self.manifest()
        self.commit(version + 1, [*runs, self._write(rows, 0, 0)])
        return version + 1

    def arrivals(self, rows: DataFrame, batch: Column) -> Iterator[int]:
        """Write ``rows`` once, dealt by the number ``batch``, and commit each batch as a run; yields the versions."""
        column, staged = free_name("_arrival", rows.columns), f"staged-{uuid.uuid4().hex}"
        with tidy(self.spark):
            rows.withColumn(column, batch).write.option("compression", "zstd").partitionBy(column).parquet(f"{self.path}/{staged}")
        for part in [x for x in self._names(staged) if "=" in x]:
            name = f"00-{uuid.uuid4().hex}"
            (here, files), (to, _) = self._hadoop(f"{staged}/{part}"), self._hadoop(f"data/{name}")
            files.mkdirs(to.getParent())
            if not files.rename(here, to):
                raise OSError(f"{here} could not become {to}")
            version, runs = self.manifest()
            self.commit(version + 1, [*runs, self._measured(name)])
            yield version + 1
        path, files = self._hadoop(staged)
        files.delete(path, True)

    def expire(self, keep: int = 1) -> list[str]:
        """Delete the runs that none of the newest ``keep`` versions names, and older versions; returns the runs' names.

        For a time without writers: a run that is written but not yet committed would go too.
        """
        known = [int(x) for x in self._names("versions") if x.isdigit()]
        live = {r.run for v in known[-keep:] for r in self.manifest(v)[1]}
        gone = [x for x in self._names("data") if x not in live]
        for name in [*(f"versions/{v:012d}" for v in known[:-keep]), *(f"data/{x}" for x in gone)]:
            path, files = self._hadoop(name)
            files.delete(path, True)
        return gone

    def tier(self, n_bytes: int) -> int:
        t, top = 0, self.least_bytes
        while n_bytes > top:
            t, top = t + 1, top * self.fan_in
        return t

    def compact(self) -> int:
        """Merge while any tier has ``fan_in`` runs; each merge is one commit. Returns the newest version."""
        while True:
            version, runs = self.manifest()
            tiers: dict[int, list[Run]] = {}
            for r in runs:
                tiers.setdefault(self.tier(r.n_bytes), []).append(r)
            full = min((t for t, rs in tiers.items() if len(rs) >= self.fan_in), default=None)
            if full is None:
                return version
            merged = sorted(tiers[full], key=lambda r: r.run)
            rows = self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.path}/data/{r.run}" for r in merged))
            shards = max(1, -(-sum(r.n_bytes for r in merged) // self.target_bytes))
            new = self._write(rows, shards, full + 1)
            gone = {r.run for r in merged}
            self.commit(version + 1, [*(r for r in runs if r.run not in gone), new])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version with ``_run``, ``_shard`` (its file) and ``_in_version``; stored columns of these names are replaced."""
        newest, runs = self.manifest(version)
        if not runs:
            raise ValueError(f"{self.path} has no rows in version {newest}")
        rows = self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.path}/data/{r.run}" for r in runs))
        file = F.col("_metadata.file_path")
        return rows.withColumns({"_run": F.regexp_extract(file, "/data/([^/]+)/", 1), "_shard": F.regexp_extract(file, "([^/]+)$", 1), "_in_version": F.lit(newest).cast("long")})


def sharded(docs: DataFrame, path: str, arrivals: int, *, target_bytes: int = 128 << 20, least_bytes: int = 1 << 20, fan_in: int = 4) -> Store:
    """Append ``docs`` as ``arrivals`` batches, by a hash of doc_id and text, compacting after every one.

    Rows are stored as they are: nulls, empty, very long and repeated texts and further columns included; equal rows
    are in one batch. The table is read once. An empty one makes one empty run.
    """
    store = Store(docs.sparkSession, path, target_bytes=target_bytes, least_bytes=least_bytes, fan_in=fan_in)
    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(arrivals))
    for _ in store.arrivals(docs, batch):
        store.compact()
    if not store.manifest()[0]:
        store.append(docs)
    return store
