"""Isolation forest: rows that random splits part from the rest early are odd.

Every tree draws its own small sample from the whole table by hashes, and is grown in a task of its own; what comes
back are its nodes as one row. Nodes of all trees, some ``2 * trees * sample`` at most, travel to the tasks as arrays;
scoring is one pass over the data in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillmart.operators.ranking import quantiles, quantiles_of


def _usual(n: int) -> float:
    """Mean depth of an unsuccessful search among n."""
    return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)


@dataclass
class Forest:
    """Nodes of all trees in arrays: feature (-1 for a leaf), cut, left child (right is next to it), depth with the leaf's usual rest."""

    features: list[str]
    fill: list[float]
    centre: list[float]
    spread: list[float]
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    sample: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 to the minus mean depth over the usual one: near 1 for odd rows, below 0.5 for others."""
        x = (np.where(np.isfinite(x), x, self.fill) - self.centre) / self.spread
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (live := self.feature[at] >= 0).any():
                i = rows[live]
                n = at[i]
                at[i] = self.left[n] + (x[i, self.feature[n]] >= self.cut[n])
            total += self.depth[at]
        return 2.0 ** (-total / len(self.roots) / _usual(self.sample))


#: A tree's sample is the least by hash of a pool so many times as large.
POOL = 4
_TREE = "tree long, feature array<int>, cut array<double>, left array<int>, depth array<double>"


def drawn(df: DataFrame, features: list[str], trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, features): each tree's ``sample`` rows, or all where there are fewer, drawn by a hash of the tree and the whole row.

    A row is in the pools of some trees in a row, of as many as it takes to make pools ``POOL`` times a sample, or, of
    larger tables, in one pool with a chance that makes them so. So the rows that move are in proportion to
    the forest, not to the table, and equal features of different rows are drawn in proportion.
    """
    n = max(df.count(), 1)
    pool = POOL * sample * trees
    each = min(trees, -(-pool // n))
    share = min(1.0, pool / (n * each))
    key = F.xxhash64(F.lit(seed), *(df[f"`{c}`"].cast("string") for c in sorted(df.columns)))
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in features), key.alias("_key"))
    dealt = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    dealt = dealt.withColumn("tree", F.pmod(F.col("_key") + F.col("_j"), F.lit(trees)).cast("long")).withColumn("_o", F.xxhash64(F.lit(seed), "tree", "_key"))
    if share < 1:
        dealt = dealt.where(F.col("_o") < F.lit(int(-(2**63) + share * 2**64)))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("_o", *features))
    return dealt.withColumn("_r", place).where(F.col("_r") <= sample).select("tree", "_r", *features)


def grown(x: np.ndarray, draw: np.random.Generator) -> tuple[list[int], list[float], list[int], list[float]]:
    """The nodes of one tree over the rows of ``x``: feature, cut, left child, depth."""
    feature, cut, left, depth = [], [], [], []

    def leaf() -> int:
        for column, value in ((feature, -1), (cut, 0.0), (left, -1), (depth, 0.0)):
            column.append(value)
        return len(feature) - 1

    limit = int(np.ceil(np.log2(max(len(x), 2))))
    stack = [(leaf(), x, 0)]
    while stack:
        node, part, d = stack.pop()
        wide = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 and d < limit else []
        if not len(wide):
            depth[node] = d + _usual(len(part))
            continue
        f = int(draw.choice(wide))
        c = float(draw.uniform(part[:, f].min(), part[:, f].max()))
        feature[node], cut[node], left[node] = f, c, leaf()
        leaf()
        high = part[:, f] >= c
        stack += [(left[node], part[~high], d + 1), (left[node] + 1, part[high], d + 1)]
    return feature, cut, left, depth


def fit(df: DataFrame, features: list[str], trees: int = 300, sample: int = 256, seed: int = 42) -> Forest:
    """Features are centred on their median and scaled by the width from the 10th to the 90th percentile; missing values are the median.

    The same table gives the same forest, however its rows are dealt. An empty one gives a forest without trees.
    """
    marks = list(quantiles_of(df, dict.fromkeys(features, [0.1, 0.5, 0.9])).values())
    fill = [0.0 if m[1] is None else m[1] for m in marks]
    spread = [1.0 if m[1] is None or m[2] == m[0] else m[2] - m[0] for m in marks]

    def grow(f: pd.DataFrame) -> pd.DataFrame:
        tree = int(f["tree"].iloc[0])
        rows = f.sort_values("_r")[features].to_numpy(float)
        nodes = grown((np.where(np.isfinite(rows), rows, fill) - fill) / spread, np.random.default_rng([seed, tree]))
        return pd.DataFrame([(tree, *nodes)], columns=["tree", "feature", "cut", "left", "depth"])

    rows = drawn(df, features, trees, sample, seed)
    found = sorted(rows.groupBy("tree").applyInPandas(grow, _TREE).collect(), key=lambda r: r["tree"])  # a row a tree
    sizes = np.array([len(r["feature"]) for r in found], int)
    roots = np.cumsum(sizes) - sizes
    joined = lambda c, kind: np.array([v for r in found for v in r[c]], kind)
    left = joined("left", int) + np.repeat(roots, sizes) * (joined("left", int) >= 0)
    return Forest(features, fill, fill, spread, roots, joined("feature", int), joined("cut", float), left, joined("depth", float), min(sample, df.count()))


def scored(df: DataFrame, forest: Forest, out: str = "score") -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(forest)

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series(sent.value.scores(np.column_stack([c.to_numpy(float) for c in columns])))

    score = F.pandas_udf(run, DoubleType(), F.PandasUDFType.SCALAR_ITER)
    return df.withColumn(out, score(*(F.col(c).cast("double") for c in forest.features)))


def anomalies(df: DataFrame, features: list[str], share: float = 0.03, **how) -> DataFrame:
    """``df`` with ``score`` and ``odd``: a score in the top ``share``, or two features beyond their 1st or 99th percentile."""
    from quillmart.operators.panel import extremes
    from quillmart.operators.storage import stored

    rows = stored(scored(df, fit(df, features, **how)), "scores")
    top = quantiles(rows, "score", [1 - share])[0]
    out = extremes(rows, features)
    return out.withColumn("odd", (F.col("score") >= F.lit(top).cast("double")) | (F.col("extremes") >= 2)).drop("anomaly")


def detection_rate(df: DataFrame, features: list[str], shocked: DataFrame, **how) -> float:
    """The share of shocked rows whose score reaches the top three percent of the usual ones."""
    forest = fit(df, features, **how)
    top = quantiles(scored(df, forest), "score", [0.97])[0]
    return scored(shocked, forest).agg(F.avg((F.col("score") >= top).cast("double")).alias("r")).first()["r"] or 0.0
