import random

import numpy as np
import pytest

from quillmart.llm import decontamination as d
from quillmart.llm import neighbours, queries

DOCS = "doc_id long, text string, item_id string, start string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


def distance(p, t):
    """Least edit distance of p to any substring of t, by the usual table."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        last, row = row, [i]
        for j, b in enumerate(t, 1):
            row.append(min(last[j - 1] + (a != b), last[j] + 1, row[-1] + 1))
    return min(row)


def test_myers_against_the_table():
    draw = random.Random(1)
    for _ in range(200):
        p = "".join(draw.choices("abc", k=draw.randrange(1, 70)))
        t = "".join(draw.choices("abc", k=draw.randrange(0, 90)))
        best, end = d.myers(d.bits_of(p), len(p), t)
        assert best == distance(p, t)
        assert best == len(p) or distance(p, t[:end]) == best


def test_op6_against_brute_force(spark):
    draw = random.Random(4)
    words = ["".join(draw.choices("etaoinshr", k=draw.randrange(2, 8))) for _ in range(300)]
    items = [(i, " ".join(draw.choices(words, k=draw.randrange(6, 30)))) for i in range(12)]
    docs = []
    for i in range(60):
        t = " ".join(draw.choices(words, k=60))
        if i % 2:
            p = list(draw.choice(items)[1])
            for _ in range(draw.randrange(0, 1 + len(p) // 8)):
                p[draw.randrange(len(p))] = draw.choice("xyz ")
            t += ", " + "".join(p).upper() + ". " + t
        docs.append((i, t))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in d.matches(frame(spark, docs), bench).collect()}
    want = {}
    for i, t in docs:
        for k, p in items:
            n = d.normal(p)
            if (x := distance(n, d.normal(t))) <= int(d.RATE * len(n)):
                want[i, k] = x
    assert got == want and len(want) > 8
    kept = d.clean(frame(spark, docs), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want} and kept.columns == ["doc_id", "text", "item_id", "start"]


def test_op6_spans_and_odd_rows(spark):
    item = "The quick brown fox jumps over the lazy dog again"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short one"), (None, item), (1, item)], "item_id long, text string")
    long = "filler words " * 60000
    docs = frame(spark, [(1, None), (2, ""), (3, "Before; THE QUICK--brown fox jumped over the lazy dog again! after"), (None, item), (5, long + item), (5, long + item), (6, "short one")])
    rows = d.matches(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.distance) for r in rows) == [(0, 1, 0), (3, 1, 2), (5, 1, 0), (5, 1, 0), (6, 4, 0)]
    r = next(r for r in rows if r.doc_id == 3)
    assert (r.start, r.length) == (8, len("THE QUICK--brown fox jumped over the lazy dog again"))
    assert d.matches(docs.limit(0), bench).count() == 0 and d.matches(docs, bench.limit(0)).count() == 0
    assert d.clean(docs, bench.limit(0)).count() == 7


def test_op6_finds_short_items_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "What is 17 times 23?"), (2, "two words"), (3, "?!"), (4, "17"), (5, "WHAT is 17 times 23")], "item_id long, text string")
    docs = frame(spark, [(1, "So: what is 17 Times 23 ?"), (2, "what is 17 times 234"), (3, "no two  words, two wordsmiths"), (4, "two wordsmiths"), (5, "x17"), (6, "somewhat is 17 times 23")])
    got = sorted((r.doc_id, r.item_id, r.distance, r.start, r.length) for r in d.matches(docs, bench).collect())
    assert got == [(1, 1, 0, 4, 19), (1, 4, 0, 12, 2), (1, 5, 0, 4, 19), (2, 4, 0, 8, 2), (3, 2, 0, 3, 10), (6, 4, 0, 12, 2)]
    assert sorted(r.doc_id for r in d.clean(docs, bench.where("item_id = 2")).collect()) == [1, 2, 4, 5, 6]


def test_op6_finds_every_verbatim_item(spark, sf):
    got = {(r.doc_id, r.item_id) for r in queries.op6_edit_decontamination(spark, sf).collect()}
    items = [(r.item_id, d.normal(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(r.doc_id, i) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for i, p in items if p in d.normal(r.text)}
    assert want and want <= got


def test_bounds_hold_and_keep_what_counts():
    draw = np.random.default_rng(3)
    for scale in (1.0, 1e-310, 1e150):
        x = draw.normal(size=(300, 24)) * draw.choice([0.01, 1.0, 50.0], size=(300, 1)) * scale
        q = x[:20]
        tiles = [neighbours.Tile.of(np.arange(s, s + 100), x[s : s + 100]) for s in (0, 100, 200)]
        packed = tiles[1].packed(3)
        again = neighbours.Tile.unpacked(24, packed["ids"][0], packed["whole"][0], packed["marks"][0])
        assert all((getattr(again, c) == getattr(tiles[1], c)).all() for c in ("ids", "rows", "scale", "size", "size_as"))
        held = neighbours.Survivors(neighbours.Tile.of(np.arange(20), q), 7)
        for t in tiles:
            held.meet(t)
        rows = held.rows()
        with np.errstate(over="ignore"):
            true = (q[:, None] * x[None]).sum(2)
        for r in range(20):
            own = rows[rows["query_id"] == r]
            assert set(sorted((c for c in range(300) if c != r), key=lambda c: -true[r, c])[:7]) <= set(own["vec_id"])
            assert all(a <= true[r, c] <= b for c, a, b in zip(own["vec_id"], own["low"], own["high"], strict=True))
            assert scale != 1.0 or len(own) < 100


def test_op10_with_a_vector_that_many_rows_share(spark):
    draw = np.random.default_rng(5)
    v = {i: [1.0, 0.5, 0.25] if i % 3 else draw.normal(size=3).round(3).tolist() for i in range(300)}
    df = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in range(0, 300, 20):
        want = sorted((-sum(a * b for a, b in zip(v[q], x, strict=True)), i) for i, x in v.items() if i != q)[:20]
        assert sorted(got[q]) == [(n, i) for n, (_, i) in enumerate(want, 1)]


def test_op10_against_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_ROWS", 64)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 8)
    v = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = {}
    for r in queries.op10_block_matrix_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {q for q in v if q % 20 == 0}
    for q, rows in got.items():
        want = sorted((-float(v[q] @ x), i) for i, x in v.items() if i != q)[:20]
        assert [(a, b) for a, b, _ in sorted(rows)] == [(n + 1, i) for n, (_, i) in enumerate(want)]
        assert [s for *_, s in sorted(rows)] == pytest.approx([-s for s, _ in want], abs=1e-12)


def test_op10_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, []), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, [None, 1.0]), (4, [2.0, 1.0]), (5, [2.0, 9.0]), (5, [2.0, 9.0]), (None, [1.0, 1.0]), (80, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, e, 1, 2) for i, e in rows], "vec_id long, embedding array<float>, score int, rank int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(df).collect())
    assert got == [(0, 1, 4, 2.0), (0, 2, 5, 2.0)]
    assert neighbours.search(df.limit(0)).count() == 0
