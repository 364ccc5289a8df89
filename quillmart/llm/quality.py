"""Quality classifier: a factorisation machine over hashed words, word shapes, structure and length.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): the second sum is the
pairwise term in time linear in the features. Words and shapes (letters as a or A, digits as 9, runs collapsed)
are hashed into ``DIM`` slots and weigh log(1 + count), scaled to unit length; structure statistics and the
length fill slots of their own. The model has a fixed size, so it travels to tasks whole; texts never move.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmart.llm.common import text_of

DIM, RANK, FIXED = 1 << 16, 8, 16
#: At most so many labelled rows are fitted, chosen by a hash of doc_id; of a repeated doc_id the text of least hash.
SAMPLE = 8_000
THRESHOLD = 0.7
_SHAPE = str.maketrans({**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "9" for c in range(48, 58)}})
_RUN = re.compile(r"(.)\1+", re.S)
_known: dict[str, tuple[int, int]] = {}


def _slots(word: str) -> tuple[int, int]:
    shape = _RUN.sub(r"\1", "".join("a" if c.islower() else "A" if c.isupper() else c for c in word.translate(_SHAPE)))
    return FIXED + zlib.crc32(word.encode("utf-8", "replace")) % (DIM - FIXED), FIXED + zlib.crc32(b"\0" + shape.encode("utf-8", "replace")) % (DIM - FIXED)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a whole text; an empty one has the fixed slots only."""
    words = text.split()
    if len(_known) > 200_000:
        _known.clear()
    pairs = []
    for w in words:
        p = _known.get(w)
        if p is None:
            p = _known[w] = _slots(w)
        pairs.append(p)
    n, size = len(words), len(text)
    fixed = np.zeros(FIXED)
    fixed[0] = 1.0
    fixed[1] = math.log1p(n) / 10
    fixed[2] = math.log1p(size) / 12
    if n:
        letters = sum(map(text.count, "aeiouAEIOU"))
        fixed[3] = size / n / 10
        fixed[4] = len(set(words)) / n
        fixed[5] = (text.count("\n") + 1) / n
        fixed[6] = letters / size
        fixed[7] = sum(map(text.count, "!#$%&*|")) / n
        fixed[8] = sum(map(text.count, ".,;:?")) / n
        fixed[9] = sum(map(text.count, "AEIOU")) / max(letters, 1)
        fixed[10] = sum(map(text.count, "0123456789")) / size
        fixed[11] = sum(map(text.count, "<>{}[]=/\\")) / n
        lines = text.split("\n")
        fixed[12] = 1 - len(set(lines)) / len(lines)
    if not n:
        return np.arange(FIXED), fixed
    slots, counts = np.unique(np.array(pairs, np.int64).ravel(), return_counts=True)
    values = np.log1p(counts)
    return np.concatenate([np.arange(FIXED), slots]), np.concatenate([fixed, values / math.sqrt(float(values @ values))])


class Machine:
    """w0, w and V of a factorisation machine."""

    def __init__(self, seed: int = 7):
        self.w0, self.w = 0.0, np.zeros(DIM)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (DIM, RANK))

    def raw(self, slots: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        vx = self.v[slots] * x[:, None]
        s = vx.sum(0)
        return float(self.w0 + self.w[slots] @ x + 0.5 * (s @ s - (vx * vx).sum())), s

    def score(self, text: str) -> float:
        z, _ = self.raw(*features(text))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 4, rate: float = 0.2, decay: float = 1e-5, seed: int = 7) -> Machine:
        """Adagrad over single rows in a seeded order."""
        gw0, gw, gv = 1e-6, np.full(DIM, 1e-6), np.full((DIM, RANK), 1e-6)
        order = np.random.default_rng(seed)
        for _ in range(rounds):
            for i in order.permutation(len(rows)):
                slots, x, y = rows[i]
                z, s = self.raw(slots, x)
                g = 1 / (1 + math.exp(-max(-35.0, min(35.0, z)))) - y
                dw = g * x + decay * self.w[slots]
                v = self.v[slots]
                dv = g * (x[:, None] * s - v * (x * x)[:, None]) + decay * v
                gw0 += g * g
                gw[slots] += dw * dw
                gv[slots] += dv * dv
                self.w0 -= rate * g / math.sqrt(gw0)
                self.w[slots] -= rate * dw / np.sqrt(gw[slots])
                self.v[slots] -= 0.25 * rate * dv / np.sqrt(gv[slots])
        return self


def held_out(column: str = "doc_id"):
    """crc32(doc_id as text) mod 4 = 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled rows that aren't held out.

    ``docs(doc_id, text)``, ``labels(doc_id, quality)``; rows with a null doc_id or quality teach nothing. The
    sample is bounded, so its ids are broadcast and its features gathered; without labels every score is 0.5.
    """
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    rows = rows.withColumn("n", one).where("n = 1").drop("n")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [features(t) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "y": f["y"], "i": [a.astype(np.int32) for a, _ in got], "x": [x.astype(np.float32) for _, x in got]})

    found = rows.mapInPandas(run, "doc_id long, y int, i array<int>, x array<float>").toPandas()
    found = found.assign(k=[zlib.crc32(np.asarray(x, np.float32).tobytes()) for x in found["x"]]).sort_values(["doc_id", "k"])
    return Machine().fit([(np.asarray(i), np.asarray(x, np.float64), int(y)) for i, x, y in zip(found["i"], found["x"], found["y"], strict=True)])


def score(docs: DataFrame, machine: Machine, column: str = "score") -> DataFrame:
    """``docs`` with ``column``, the probability of label 1 of every whole text; a null text is empty."""
    sent = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w.astype(np.float32), machine.v.astype(np.float32)))

    @F.pandas_udf("double")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Machine.__new__(Machine)
        m.w0, m.w, m.v = sent.value
        for texts in parts:
            yield pd.Series([m.score(t) for t in texts], dtype="float64")

    return docs.withColumn(column, scores(text_of()))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, repeated doc_ids and null ones included."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels, sample))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
