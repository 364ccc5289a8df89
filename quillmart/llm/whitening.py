"""Embedding whitening from an exact scatter matrix, by residue-number arithmetic.

Entries become whole numbers, so the scatter matrix of the centred vectors n*x - S is one of whole numbers as well,
beyond what a double or a long holds. It is computed modulo several primes instead: every partition takes residues,
centres them modulo each prime and multiplies them as floating-point matrices, with so few rows at a time that each
sum stays below 2**53 and is exact. Partial sums are added over partitions, and Chinese remaindering gives the exact
entries: primes are taken until their product is over twice the greatest value that an entry can have. Only then
doubles come in: V is each entry over n**3, correctly rounded, and its eigenvectors follow in double precision.

The rows are read four times (bounds, scatter, co-moments of the result, result); what reaches the driver is a
matrix a vector length, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Residues stay below 2**PRIME_BITS, so the products of ROWS of them add up below 2**53.
PRIME_BITS, ROWS = 20, 8192
#: Partial sums meet in groups of about FAN, in two steps.
FAN = 256
_LONG = float(1 << 62)


def primes(above: int) -> list[int]:
    """The greatest primes below 2**PRIME_BITS whose product exceeds ``above``."""
    top = 1 << PRIME_BITS
    sieve = np.ones(top, bool)
    sieve[:2] = False
    for i in range(2, 1 << (PRIME_BITS // 2)):
        if sieve[i]:
            sieve[i * i :: i] = False
    found, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        found.append(p)
        product *= p
        if product > above:
            return found
    raise ValueError("the scatter matrix is beyond all primes")


def usable(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(vector length, vec_ids, vectors as double, whole numbers x) of the rows of (vec_id, embedding) that remain."""
    ids, lists = batch.column(0), batch.column(1)
    here = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
    lists = lists.take(pa.array(here))
    sizes = np.diff(np.asarray(lists.offsets, dtype=np.int64))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    first = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == dim)
        c = flat[first[rows][:, None] + np.arange(dim)] if len(rows) < len(sizes) else flat.reshape(-1, dim)
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = np.floor(c * SCALE)
            fine = (np.abs(scaled) < _LONG).all(1)
        if fine.any():
            yield dim, ids.take(pa.array(here[rows[fine]])), c[fine], scaled[fine].astype(np.int64) + SHIFT


def residue_scatter(x: np.ndarray, n: int, sums: list[int], p: int) -> np.ndarray:
    """Sum over rows of (n*x - S)(n*x - S)' modulo p; every product and sum stays exact in double precision."""
    total = np.zeros((x.shape[1], x.shape[1]), np.int64)
    s = np.array([v % p for v in sums], np.int64)
    for a in range(0, len(x), ROWS):
        y = (((x[a : a + ROWS] % p) * (n % p) - s) % p).astype(np.float64)
        total += (y.T @ y).astype(np.int64) % p
    return total % p


def reconstructed(residues: dict[int, np.ndarray]) -> list[list[int]]:
    """The whole numbers, of either sign, that have these residues by prime."""
    product = 1
    for p in residues:
        product *= p
    total = 0
    for p, r in residues.items():
        rest = product // p
        total = total + r.astype(object) * (rest * pow(rest, -1, p))
    total = total % product
    return [[v - product if 2 * v > product else v for v in row] for row in total.tolist()]


@dataclass(frozen=True)
class Model:
    """Whitening of vectors of one length: x to (x - S/n) . vectors / sqrt(values)."""

    n: int
    sums: tuple[int, ...]
    bound: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @classmethod
    def of(cls, n: int, sums: list[int], bound: int, scatter: list[list[int]], components: int) -> Model:
        cube = n**3
        v = np.array([[t / cube for t in row] for row in scatter])  # of whole numbers, correctly rounded
        e, w = np.linalg.eigh(v)
        e, w = e[::-1][:components], w[:, ::-1][:, :components]
        keep = e > max(e[0], 0) * len(v) * np.finfo(float).eps if len(e) else e > 0
        e, w = e[keep], w[:, keep]
        if len(e):
            w = w * np.sign(w[np.abs(w).argmax(0), np.arange(w.shape[1])])
        return cls(n, tuple(sums), bound, e, w, sum(scatter[i][i] for i in range(len(v))) / cube)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - S: as long where all fit, else as Python's numbers."""
        kind = np.int64 if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return ((y / self.n).astype(np.float64) @ self.vectors) / np.sqrt(self.values)

    def deviations(self, y: np.ndarray) -> list[int | None]:
        if y.dtype != object and y.shape[1] * self.bound**2 < 1 << 62:
            return (y * y).sum(1).tolist()
        return [d if d < 1 << 63 else None for d in (sum(v * v for v in row) for row in y.tolist())]


def _gathered(partial: DataFrame, keys: list[str], merge) -> DataFrame:
    """The rows of each ``keys`` made one by ``merge(frame)``, in two steps so that no task gets every partition's."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        return f.iloc[:1].assign(**{c: [v] for c, v in merge(f).items()})

    kinds = dict(partial.dtypes)
    some = partial.withColumn("part", F.pmod("part", F.lit(FAN)))
    some = some.groupBy("part", *keys).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in some.columns)).drop("part")
    return some.groupBy(*keys).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in some.columns))


def _added(f: pd.DataFrame) -> dict:
    total = np.zeros(len(f["value"].iloc[0]) // 8, np.int64)
    for v in f["value"]:
        total += np.frombuffer(v, "<i8")
    return {"value": total.astype("<i8").tobytes()}


def _bounds(rows: DataFrame) -> dict[int, tuple[int, list[int], int]]:
    """By vector length: n, the sums of each dimension, and the greatest |n*x - S| there can be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for b in batches:
            for dim, _, _, x in usable(b):
                # halves, so that no sum overflows
                new = [len(x), (x >> 31).sum(0), (x & 0x7FFFFFFF).sum(0), x.min(0), x.max(0)]
                old = by.get(dim)
                by[dim] = new if old is None else [old[0] + new[0], old[1] + new[1], old[2] + new[2], np.minimum(old[3], new[3]), np.maximum(old[4], new[4])]
        dims = [d for d, v in by.items() for _ in range(d)]
        columns = [[v[0] for d, v in by.items() for _ in range(d)], *([int(t) for v in by.values() for t in v[k]] for k in range(1, 5))]
        at = [i for d in by for i in range(d)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (dims, at, *columns)], names=["dim", "i", "n", "high", "low", "least", "most"])

    partial = rows.mapInArrow(run, "dim long, i long, n long, high long, low long, least long, most long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = partial.groupBy("dim", "i").agg(F.sum("n").alias("n"), wide("high"), wide("low"), F.min("least").alias("least"), F.max("most").alias("most"))
    by: dict[int, list] = {}
    for r in found.collect():  # a row a dimension
        by.setdefault(r.dim, []).append(r)
    out = {}
    for dim, got in by.items():
        got.sort(key=lambda r: r.i)
        out[dim] = got[0].n, [(int(r.high) << 31) + int(r.low) for r in got], max(r.n * (r.most - r.least) for r in got)
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The whitening of ``rows(vec_id, embedding)``, by vector length."""
    found = _bounds(rows)
    by_dim = {dim: (n, sums, primes(2 * n * bound * bound)) for dim, (n, sums, bound) in found.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for dim, _, _, x in usable(b):
                n, sums, moduli = by_dim[dim]
                for p in moduli:
                    own = residue_scatter(x, n, sums, p)
                    total[dim, p] = (total[dim, p] + own) % p if (dim, p) in total else own
        part = TaskContext.get().partitionId()
        for (dim, p), m in total.items():
            value = pa.array([row.astype("<i8").tobytes() for row in m], pa.binary())
            same = [pa.array([v] * dim, pa.int64()) for v in (part, dim, p)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(range(dim), pa.int64()), value], names=["part", "dim", "prime", "i", "value"])

    partial = rows.mapInArrow(run, "part long, dim long, prime long, i long, value binary")
    residues: dict[int, dict[int, np.ndarray]] = {}
    for r in _gathered(partial, ["dim", "prime", "i"], _added).collect():  # a matrix a prime and vector length
        m = residues.setdefault(r.dim, {}).setdefault(r.prime, np.zeros((r.dim, r.dim), np.int64))
        m[r.i] = np.frombuffer(r.value, "<i8") % r.prime
    return {dim: Model.of(found[dim][0], found[dim][1], found[dim][2], reconstructed(by_prime), components) for dim, by_prime in residues.items()}


def _merged(f: pd.DataFrame) -> dict:
    """Count, mean and centred co-moments of several sets together."""
    n, mean, moments = 0, 0.0, 0.0
    for k, m, c in zip(f["n"].tolist(), f["mean"], f["moments"], strict=True):
        m = np.frombuffer(m)
        d = m - mean
        moments = moments + np.frombuffer(c).reshape(len(m), len(m)) + np.outer(d, d) * (n * k / (n + k))
        mean, n = mean + d * (k / (n + k)), n + k
    return {"n": n, "mean": mean.tobytes(), "moments": moments.tobytes()}


def identity_errors(rows: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """By vector length: the largest absolute entry of the whitened rows' covariance minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, list[dict]] = {}
        for b in batches:
            for dim, _, _, x in usable(b):
                m = models[dim]
                w = m.whitened(m.centred(x))
                d = w - w.mean(0)
                sets.setdefault(dim, []).append({"n": len(w), "mean": w.mean(0).tobytes(), "moments": (d.T @ d).tobytes()})
                if len(sets[dim]) > 100:
                    sets[dim] = [_merged(pd.DataFrame(sets[dim]))]
        rows = [{"part": TaskContext.get().partitionId(), "dim": dim} | _merged(pd.DataFrame(own)) for dim, own in sets.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema({"part": pa.int64(), "dim": pa.int64(), "n": pa.int64(), "mean": pa.binary(), "moments": pa.binary()}))

    partial = rows.mapInArrow(run, "part long, dim long, n long, mean binary, moments binary")
    out = {}
    for r in _gathered(partial, ["dim"], _merged).collect():  # a row a vector length
        c = np.frombuffer(r.moments) / r.n
        k = len(r.mean) // 8
        out[r.dim] = float(np.abs(c.reshape(k, k) - np.eye(k)).max(initial=0.0))
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of ``vectors(vec_id, embedding)``: one row per remaining vector and component.

    Returns vec_id, component (from 1), n (vectors fitted), deviation (sum over dimensions of (n*x - S)**2, exact;
    null where it is beyond a long), whitened, explained (the component's share of the trace) and identity_error (one
    value), where x is floor(1024*c) + 100000 of each entry c and S the sums of x.

    Vectors that are null or hold null or non-finite entries are dropped, and so are those with an entry beyond 2**52,
    whose x no long could hold. Rows of repeated and null vec_ids are vectors of their own. Vectors of different lengths
    are fitted apart, each by its own length, and empty ones have no components; neither have directions without
    variance, so a single vector, or copies of one, gives no rows, nor does an empty table. Of equal eigenvalues
    either order may come out. Other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    models = fit(rows, components)
    error = max(identity_errors(rows, models).values(), default=0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, ids, _, x in usable(b):
                m = models[dim]
                k, y = len(m.values), m.centred(x)
                if not k:
                    continue
                again = np.repeat(np.arange(len(ids)), k)
                columns = [
                    ids.take(pa.array(again)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))),
                    pa.array(np.full(len(again), m.n)),
                    pa.array(m.deviations(y), pa.int64()).take(pa.array(again)),
                    pa.array(m.whitened(y).ravel()),
                    pa.array(np.tile(m.values / m.trace, len(ids))),
                    pa.array(np.full(len(again), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
