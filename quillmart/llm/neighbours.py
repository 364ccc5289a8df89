"""Nearest neighbours by a block matrix join over int8 tiles.

Each vector is scaled to int8 by its largest component once, and vectors travel as tiles of these with their scales
and absolute sums. A pair of tiles multiplies as whole numbers; with x = s n + e and every |e| at most s / 2, the
product of two rows differs from the true inner product by at most s_x/2 * |q|_1 + s_q/2 * |s_x n_x|_1. Each task
keeps the k greatest lower bounds of every query; a candidate whose upper bound is below the least of them can't
count. Of what is left over all tasks the same is asked once more, and only for those pairs the original vectors are
fetched, multiplied component by component in double precision and merged by a heap of k a query. The result is
exact: bounds only skip what can't count.

Of equal vectors only the k + 1 of least vec_id are candidates: any further one has k others before it in every
query's list. So a vector that a third of all rows share costs no more than others.

Every query block meets every tile once: the tile side is dealt in groups, so the number of tasks grows with both
sides and each holds two tiles at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmart.llm.common import stored

QUERY_ROWS, TILE_ROWS, GROUP_TILES, STRIP = 2048, 4096, 4, 256
_TILE = "dim int, block long, ids binary, whole binary, marks binary"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, e (array of double): the rows that take part; of repeated vec_ids the least vector."""
    v = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.where(F.col("e").isNotNull() & finite & F.exists("e", lambda x: x != 0)).groupBy("vec_id").agg(F.min("e").alias("e"))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 rows and their scales."""
    top = np.abs(x).max(1)
    scale = np.where(top / 127.0 > 0, top / 127.0, top)
    return np.rint(x / scale[:, None]).astype(np.int8), scale


@dataclass
class Tile:
    """int8 rows with, for each, its vec_id, scale, absolute sum and absolute sum as quantised."""

    ids: np.ndarray
    rows: np.ndarray
    scale: np.ndarray
    size: np.ndarray
    size_as: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray) -> Tile:
        n, scale = quantised(x)
        return cls(ids, n, scale, np.abs(x).sum(1), scale * np.abs(n.astype(np.int64)).sum(1))

    def packed(self, block: int) -> dict:
        marks = np.stack([self.scale, self.size, self.size_as])
        return {"dim": [self.rows.shape[1]], "block": [block], "ids": [self.ids.astype("<i8").tobytes()], "whole": [self.rows.tobytes()], "marks": [marks.astype("<f8").tobytes()]}

    @classmethod
    def unpacked(cls, dim: int, ids: bytes, whole: bytes, marks: bytes) -> Tile:
        return cls(np.frombuffer(ids, "<i8"), np.frombuffer(whole, np.int8).reshape(-1, dim), *np.frombuffer(marks, "<f8").reshape(3, -1))


def _tiles(v: DataFrame, rows: int) -> tuple[DataFrame, int]:
    n = max(1, -(-v.count() // rows))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("vec_id")
        return pd.DataFrame(Tile.of(f["vec_id"].to_numpy("<i8"), np.array(f["e"].tolist(), dtype="<f8")).packed(f["block"].iloc[0]))

    v = v.withColumns({"dim": F.size("e"), "block": F.pmod(F.xxhash64("vec_id"), F.lit(n))})
    return stored(v.groupBy("dim", "block").applyInPandas(pack, _TILE), "tiles"), n


def bounds(q: Tile, x: Tile) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all inner products of two tiles from below and above; a row's product with itself has minus infinity for both."""
    exact_in = np.float32 if q.rows.shape[1] <= 1000 else np.float64  # sums of products stay below 2 ** 24
    with np.errstate(over="ignore", invalid="ignore"):
        about = (q.rows.astype(exact_in) @ x.rows.astype(exact_in).T).astype(np.float64) * q.scale[:, None] * x.scale
        error = 0.5 * q.size[:, None] * x.scale + 0.5 * q.scale[:, None] * x.size_as
        error = error * (1 + 1e-9) + 1e-12 * (1 + np.abs(about))
        low, high = np.nan_to_num(about - error, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(about + error, nan=np.inf, posinf=np.inf, neginf=-np.inf)
    own = q.ids[:, None] == x.ids
    low[own] = high[own] = -np.inf
    return low, high


class Survivors:
    """What of a query tile's pairs can count, over the tiles it met so far."""

    def __init__(self, q: Tile, k: int):
        self.q, self.k, self.best, self.found = q, k, np.full((len(q.ids), k), -np.inf), []

    def meet(self, x: Tile) -> None:
        for s in range(0, len(self.q.ids), STRIP):
            part = slice(s, s + STRIP)
            q = Tile(*(c[part] for c in (self.q.ids, self.q.rows, self.q.scale, self.q.size, self.q.size_as)))
            low, high = bounds(q, x)
            both = np.concatenate([self.best[part], low], 1)
            self.best[part] = np.partition(both, -self.k, axis=1)[:, -self.k :]
            i, j = np.nonzero((high >= self.best[part].min(1)[:, None]) & (high > -np.inf))
            self.found.append((i + s, x.ids[j], low[i, j], high[i, j]))

    def rows(self) -> pd.DataFrame:
        i, ids, low, high = (np.concatenate(c) for c in zip(*self.found, strict=True))
        keep = high >= self.best.min(1)[i]
        return pd.DataFrame({"query_id": self.q.ids[i[keep]], "vec_id": ids[keep], "low": low[keep], "high": high[keep]})


def search(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows by inner product of each vec_id divisible by ``every``.

    Ties go to the smaller vec_id. Vectors null, empty, zero or holding null or non-finite components and rows
    with a null vec_id take no part; vectors meet those of their own length; a query with fewer than k candidates
    has them all; an empty table gives no rows. Other columns are ignored.
    """
    v = stored(usable(vectors), "vectors")
    # k + 1 of each set of equal vectors; the limit is taken before rows move
    alike = F.row_number().over(Window.partitionBy("e").orderBy("vec_id"))
    tiles, n_tiles = _tiles(stored(v.withColumn("n", alike).where(F.col("n") <= k + 1).drop("n"), "candidates"), TILE_ROWS)
    queries, n_queries = _tiles(v.where(F.col("vec_id") % every == 0), QUERY_ROWS)
    groups = -(-n_tiles // GROUP_TILES)
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.select("dim", F.col("block").alias("q"), numbers(groups).alias("g"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "whole", "marks")))
    right = tiles.select("dim", numbers(n_queries).alias("q"), F.pmod("block", F.lit(groups)).alias("g"), "ids", "whole", "marks")
    pairs = left.join(right.hint("shuffle_merge"), ["dim", "q", "g"])

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for f in frames:
            for r in f.itertuples(index=False):
                if now != (r.dim, r.q, r.g):
                    if held is not None:
                        yield held.rows()
                    now, held = (r.dim, r.q, r.g), Survivors(Tile.unpacked(r.dim, r.q_ids, r.q_whole, r.q_marks), k)
                held.meet(Tile.unpacked(r.dim, r.ids, r.whole, r.marks))
        if held is not None:
            yield held.rows()

    found = stored(pairs.sortWithinPartitions("dim", "q", "g").mapInPandas(meet, "query_id long, vec_id long, low double, high double"), "survivors")
    lowest = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low"), "vec_id"))
    floor = found.withColumn("n", lowest).where(F.col("n") <= k).groupBy("query_id").agg(F.min("low").alias("floor"), F.count("*").alias("n"))
    left_over = found.join(floor, "query_id").where((F.col("n") < k) | (F.col("high") >= F.col("floor"))).select("query_id", "vec_id")
    both = left_over.join(v.select(F.col("vec_id").alias("query_id"), F.col("e").alias("q")), "query_id").join(v, "vec_id").select("query_id", "vec_id", "q", "e")

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, heap = None, []
        for f in frames:
            scores = _products(f["q"].tolist(), f["e"].tolist())
            for query, vec, score in zip(f["query_id"].tolist(), f["vec_id"].tolist(), scores, strict=True):
                if query != now:
                    yield _ranked(now, heap)
                    now, heap = query, []
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                elif (score, -vec) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec))
        yield _ranked(now, heap)

    rows = both.repartition("query_id").sortWithinPartitions("query_id")
    return rows.mapInPandas(merge, "query_id long, rank int, vec_id long, score double")


def _products(q: list, x: list) -> list[float]:
    """Inner products in double precision, component by component; the vectors of a pair are of one length."""
    out, dims = np.zeros(len(q)), np.fromiter(map(len, q), np.int64, len(q))
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        a, b, total = np.array([q[i] for i in at]), np.array([x[i] for i in at]), np.zeros(len(at))
        for c in range(d):
            total += a[:, c] * b[:, c]
        out[at] = total
    return out.tolist()


def _ranked(query: int | None, heap: list[tuple[float, int]]) -> pd.DataFrame:
    rows = [(query, n, -v, s) for n, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
    return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"]).astype({"query_id": "int64", "rank": "int32", "vec_id": "int64", "score": "float64"})
