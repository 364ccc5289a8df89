"""Medians and counts of groups against NumPy, with brackets so narrow that large groups are looked at in part."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmart.operators import ranking


def groups():
    r = np.random.default_rng(4)
    parts = [pd.DataFrame({"g": "even", "v": r.normal(size=600)}), pd.DataFrame({"g": "odd", "v": r.integers(0, 5, 601).astype(float)}), pd.DataFrame({"g": "same", "v": 7.0}, index=range(500))]
    parts += [pd.DataFrame({"g": "hot", "v": np.where(r.random(900) < 0.4, 3.0, r.exponential(1e6, 900))}), pd.DataFrame({"g": ["one"], "v": [2.0]}), pd.DataFrame({"g": ["two", "two"], "v": [1.0, 5.0]})]
    parts += [pd.DataFrame({"g": "none", "v": [None, None]}), pd.DataFrame({"g": [None] * 31, "v": r.normal(size=31)}), pd.DataFrame({"g": "holes", "v": [None, 4.0, None, 1.0, 9.0]})]
    f = pd.concat(parts, ignore_index=True)
    return f.assign(k=range(len(f)))


def frame(spark, f):
    rows = [(None if pd.isna(g) else g, None if pd.isna(v) else float(v), int(k)) for g, v, k in f[["g", "v", "k"]].itertuples(index=False)]
    return spark.createDataFrame(rows, "g string, v double, k long").repartition(5)


@pytest.mark.parametrize("bracketed", [10_000, 40])
def test_medians_of_groups(spark, monkeypatch, bracketed):
    monkeypatch.setattr(ranking, "BRACKETED", bracketed)
    f = groups()
    df = frame(spark, f)
    got = {r.g: (r.m, r.m_n) for r in ranking.medians(df, "v", ["g"], "m").collect()}
    want = {(None if pd.isna(g) else g): (None if x.v.dropna().empty else float(x.v.median()), int(x.v.notna().sum())) for g, x in f.groupby("g", dropna=False)}
    assert got == want
    others = {r.k: r.m for r in ranking._median_of_others(df.where("v is not null"), "v", ["g"], "m").collect()}
    for _, x in f[f.v.notna()].groupby("g", dropna=False):
        values = x.v.to_numpy(float)
        for i, k in enumerate(x.k):
            rest = np.delete(values, i)
            assert others[k] == (float(np.median(rest)) if len(rest) else None)


def test_middles_at_a_finer_accuracy(spark):
    f = pd.DataFrame({"g": np.arange(60_000) % 2, "v": np.random.default_rng(1).integers(0, 9000, 60_000).astype(float)})
    got = {r.g: r.m for r in ranking.medians(spark.createDataFrame(f), "v", ["g"], "m").collect()}
    assert got == f.groupby("g").v.median().to_dict()


@pytest.mark.parametrize("parts", [2, 64])
def test_counts_upto(spark, parts):
    f = groups()
    got = {r.k: (r.c, r.n) for r in ranking.counts_upto(frame(spark, f), "v", ["g"], "c", "n", parts).collect()}
    for _, x in f.groupby("g", dropna=False):
        values = x.v.dropna().to_numpy(float)
        for v, k in zip(x.v, x.k, strict=True):
            assert got[k] == ((None, None) if pd.isna(v) else (int((values <= v).sum()), len(values)))


def test_robust_z_against_a_loop(spark):
    f = groups()
    got = {r.k: r for r in ranking.robust_z(frame(spark, f), "v", ["g"], "k").collect()}
    seen = 0
    for g, x in f[f.v.notna() & f.g.notna()].groupby("g"):
        values = x.v.to_numpy(float)
        for i, k in list(enumerate(x.k))[:40]:
            rest = np.delete(values, i)
            if len(rest) < 20:
                assert k not in got
                continue
            m = np.median(rest)
            mad = np.median(np.abs(rest - m))
            z = 0.6745 * (values[i] - m) / mad if mad > 1e-9 else 0.0
            assert got[k].robust_z == pytest.approx(float(np.clip(z, -10, 10))) and got[k].percentile == pytest.approx((rest <= values[i]).mean() * 100), g
            seen += 1
    assert seen > 100 and F
