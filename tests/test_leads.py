"""Similarity to the best stores against every pair; equal vectors are compared once."""

import math
import random

from quillmart.operators import leads


def every_pair(candidates, heroes, k=5):
    numbers = [[r[3 + c] or 0.0 for r in [*candidates, *heroes]] for c in range(2)]
    percent = [{v: (sum(x < v for x in column) + (sum(x == v for x in column) + 1) / 2) / len(column) for v in set(column)} for column in numbers]
    made = lambda r: (r[1] or leads.UNKNOWN, r[2] or leads.UNKNOWN, [percent[c][r[3 + c] or 0.0] for c in range(2)])
    out = []
    for r in candidates:
        i, c, v = made(r)
        sims = [((i == hi) + (c == hc) + sum(x * y for x, y in zip(v, w, strict=True))) / math.sqrt((2 + sum(x * x for x in v)) * (2 + sum(x * x for x in w))) for hi, hc, w in map(made, heroes)]
        best = sorted(sims)[-k:]
        out.append((r[0], round((sum(best) / len(best) + 1) / 2 * 100, 8)))
    return sorted(out)


def rows(rng, n):
    return [(k, rng.choice(["a", "b", None]), rng.choice(["x", "y", "z", None]), rng.choice([None, float(rng.randint(0, 9))]), float(rng.randint(0, 3))) for k in range(n)]


KINDS = "lead int, industry string, city string, g double, r double"


def test_similarity_is_that_of_every_pair(spark):
    rng = random.Random(1)
    for n, h in ((200, 60), (5, 3)):
        a, b = rows(rng, n), rows(rng, h)
        got = leads.similarity(spark.createDataFrame(a, KINDS), spark.createDataFrame(b, KINDS), "lead", ["g", "r"])
        assert sorted((r.lead, round(r.similarity, 8)) for r in got.collect()) == every_pair(a, b)
    none = leads.similarity(spark.createDataFrame(a, KINDS), spark.createDataFrame(b, KINDS).limit(0), "lead", ["g", "r"])
    assert {r.similarity for r in none.collect()} == {0.0}


def test_no_row_is_made_of_a_pair(spark):
    a, b = ([(k, "a", "x", float(k % 7), 0.0) for k in range(n)] for n in (300, 100))
    df = leads.similarity(spark.createDataFrame(a, KINDS), spark.createDataFrame(b, KINDS), "lead", ["g", "r"])
    assert df.count() == 300
    assert "FlatMapGroupsInArrow" in df._jdf.queryExecution().executedPlan().toString()
