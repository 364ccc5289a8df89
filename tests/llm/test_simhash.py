import random
import re

import numpy as np
import xxhash

from quillmart.llm import queries, simhash
from quillmart.llm.common import components
from quillmart.llm.simhash import NARROW, WIDE


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, f0 int, component_id string")


def brute(texts):
    """Fingerprints bit by bit and classes over all pairs."""
    prints = {}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return prints, linked(prints, lambda a, b: (a ^ b).bit_count() <= 2)


def linked(prints, near):
    root = {d: d for d in prints}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sorted(prints):
        for b in prints:
            if a < b and near(prints[a], prints[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d in prints}


def test_op4_against_all_pairs(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    prints, classes = brute(texts)
    got = {r.doc_id: r for r in queries.op4_simhash_pigeonring(spark, sf).collect()}
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == prints
    assert {d: r.component_id for d, r in got.items()} == classes


def test_links_of_planted_fingerprints(spark, monkeypatch):
    """Chains, bunches larger than a part, and random ones, against all pairs."""
    monkeypatch.setattr(simhash, "SMALL", 4)
    draw = random.Random(5)
    prints, n = {}, 0
    for _ in range(40):
        x = draw.getrandbits(64)
        for _ in range(draw.choice([1, 2, 5, 30])):
            if x not in prints.values():
                prints[n] = x
                n += 1
            for _ in range(draw.choice([0, 1, 2, 3])):
                x ^= 1 << draw.randrange(64)
    rows = [(d, int(np.uint64(x).astype(np.int64))) for d, x in prints.items()]
    edges = simhash.links(spark.createDataFrame(rows, "id long, f0 long"), NARROW)
    got = {r.node: r.component for r in components(edges).collect()}
    assert {d: got.get(d, d) for d in prints} == linked(prints, lambda a, b: (a ^ b).bit_count() <= 2)


def test_large_groups_in_parts(spark, monkeypatch):
    import pandas as pd

    key = np.array([1, 2, 2, 2, 3, 4, 4], np.int64)
    f = pd.DataFrame({"key": key, "id": range(7), "cleared": 0})
    for cut in range(1, 7):
        out = pd.concat(simhash._shared(iter([f.iloc[:cut].reset_index(drop=True), f.iloc[cut:].reset_index(drop=True)])))
        assert sorted(out["id"]) == [1, 2, 3, 5, 6]
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2, 384)
    rows = {}
    for i in range(2600):  # one block in common: a key of 2600 members; links only inside each of three bunches
        bits = base.copy()
        bits[24:] = np.random.default_rng(i % 3).integers(0, 2, 360)
        flip = draw.choice(np.arange(24, 384), 6, replace=False)
        bits[flip] ^= 1
        rows[i] = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)
    df = spark.createDataFrame([(i, *map(int, x)) for i, x in rows.items()], "id long, " + ", ".join(f"f{i} long" for i in range(6)))
    got = {r.node: r.component for r in components(simhash.links(df, WIDE)).collect()}
    assert got == {i: i % 3 for i in range(2600)}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (4, "a"), (None, "a"), (5, "A"), (6, "word " * 40000), (7, "word " * 39000)]
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.classes(frame(spark, rows)).collect())
    assert got == [(0, None), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (6, 6), (7, 6)]
    assert simhash.classes(frame(spark, [])).count() == 0
    kept = simhash.keep_one(frame(spark, rows))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 4, 6] and kept.columns == ["doc_id", "text", "f0", "component_id"]


def test_wide_scheme_finds_similar_and_leaves_others(spark):
    draw = random.Random(2)
    vocabulary = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(2000)]
    rows, want = [], {}
    for i in range(60):
        w = draw.choices(vocabulary, k=400)
        rows.append((10 * i, " ".join(w)))
        near = list(w)
        near[draw.randrange(400)] = "x"
        near[draw.randrange(400)] = "y"  # similarity about 0.95
        rows.append((10 * i + 1, " ".join(near)))
        far = [x if draw.random() > 0.15 else "z" for x in w]
        rows.append((10 * i + 2, " ".join(far)))
        want |= {10 * i: 10 * i, 10 * i + 1: 10 * i, 10 * i + 2: 10 * i + 2}
    got = {r.doc_id: r.component_id for r in simhash.classes(frame(spark, rows), WIDE).collect()}
    assert sum(got[d] == c for d, c in want.items()) >= len(want) - 1
    assert all(got[d] == d for d in want if d % 10 == 2)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


def similar_pairs(rows, t):
    sets = {d: {x for x in simhash.shingles(text, 5)} for d, text in rows}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def test_wide_scheme_at_its_threshold(spark):
    """Pairs of 0.8 to 0.85 are found, pairs just below aren't linked."""
    draw = random.Random(4)
    rows, alike = [], 0
    for i in range(300):
        w = [f"w{draw.randrange(10**6)}" for _ in range(300)]
        cut = draw.choice([*range(28, 33), 40, 42])  # a tail of other words: (296 - cut) / (296 + cut)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-cut] + [f"v{draw.randrange(10**6)}" for _ in range(cut)]))]
        alike += cut < 33
    want = similar_pairs(rows, 0.8)
    assert len(want) == alike > 150
    got = {r.doc_id: r.component_id for r in simhash.classes(frame(spark, rows), WIDE).collect()}
    found = {(a, b) for a, b in ((2 * i, 2 * i + 1) for i in range(300)) if got[a] == got[b]}
    assert found <= want
    assert len(found) >= 0.92 * len(want)


def test_large_group_is_verified_across_its_star(spark, monkeypatch):
    """Members near a group's least one but not similar to it are still linked with each other."""
    monkeypatch.setattr(simhash, "SMALL", 2)
    draw = random.Random(6)
    w = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    tails = [[f"v{draw.randrange(10**6)}" for _ in range(40)] for _ in range(3)]
    rows = [(0, " ".join(w))] + [(10 * k + i, " ".join(w[:-40] + t[:-i] + [f"u{k}{i}{j}" for j in range(i)])) for k, t in enumerate(tails, 1) for i in range(1, 5)]
    got = {r.doc_id: r.component_id for r in simhash.classes(frame(spark, rows), WIDE).collect()}
    assert got == {0: 0} | {10 * k + i: 10 * k + 1 for k in (1, 2, 3) for i in range(1, 5)}


def test_wide_scheme_counts_sets_not_repeats(spark):
    """Copies that differ in how often a passage stands in them meet; texts that share only a repeated passage don't."""
    draw = random.Random(8)
    words = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    rows, want = [], {}
    for i in range(10):
        text, passage = words(200), words(20)
        near = text + " " + passage
        rows += [(10 * i + 1, near), (10 * i + 2, near + " " + near), (10 * i + 3, near + (" " + passage) * 50), (10 * i + 4, words(60) + (" " + passage) * 50)]
        want |= {10 * i + k: 10 * i + 1 for k in (1, 2, 3)} | {10 * i + 4: 10 * i + 4}
    got = {r.doc_id: r.component_id for r in simhash.classes(frame(spark, rows), WIDE).collect()}
    assert got == want


def test_links_are_the_same_however_frames_are_cut(spark, monkeypatch):
    """Which pairs of wide fingerprints are candidates depends on the two alone: on no frame, batch or group size."""
    draw = np.random.default_rng(11)
    base = draw.integers(0, 2, (12, 384))
    rows = []
    for i in range(240):
        bits = base[i % 12].copy()
        flip = draw.permutation(np.arange(32, 384))[: draw.integers(5, 45)]
        bits[np.concatenate([flip, draw.permutation(32)[: draw.integers(0, 16)]])] ^= 1
        rows.append([i, *np.packbits(bits, bitorder="little").view("<i8").tolist()])
    nodes = spark.createDataFrame(rows, "id long, " + ", ".join(f"f{k} long" for k in range(6)))
    lanes = np.array([r[1:] for r in rows], np.int64).view(np.uint64)
    bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8), axis=1, bitorder="little")
    want = set()
    for i in range(240):
        for j in range(i):
            block = any((bits[i][at] == bits[j][at]).all() for at in WIDE.places)
            if block and (bits[i] != bits[j]).sum() <= WIDE.limit and (bits[i][:32] != bits[j][:32]).sum() <= simhash.SKETCHED:
                want.add((i, j))

    def reached(pairs):
        root = list(range(240))
        for a, b in sorted(pairs):
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        return root

    assert len(want) > 200
    for batch, small in (("2", 16), ("37", 16), ("10000", 16), ("10000", 3), ("5", 300)):
        monkeypatch.setattr(simhash, "SMALL", small)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {(max(r.a, r.b), min(r.a, r.b)) for r in simhash.links(nodes, WIDE).collect()}
        assert reached(got) == reached(want) and (got == want or small < 300)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
