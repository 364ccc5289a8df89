import hashlib
import random

import numpy as np
import pandas as pd

from quillmart.llm import queries, repeats

DOCS = "doc_id long, text string, lo string, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


def brute(docs, n=100):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - n + 1):
            w = b[s : s + n]
            if w in seen:
                gone[s : s + n] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out[d] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_op9_on_the_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(queries.op9_radix_repeats(spark, sf)) == brute(docs)


def test_op9_on_made_up_cases(spark, monkeypatch):
    draw = random.Random(6)
    word = lambda n: "".join(draw.choices("abcdefghij klmnop", k=n))
    shared = [word(n) for n in (99, 100, 101, 160, 400)]
    docs = [(7, "a" * 350), (3, "ab" * 180), (9, "a" * 99), (11, "é" * 120), (12, "x" + "é" * 70)]
    for i in range(60):
        docs.append((20 + i, word(draw.randrange(0, 150)) + draw.choice(shared) + word(draw.randrange(0, 60)) + draw.choice(shared)[draw.randrange(60) :] + word(30)))
    docs += [(200, docs[10][1]), (201, docs[10][1]), (1, docs[10][1]), (300, shared[4] * 3)]
    want = brute(docs)
    assert result(repeats.remove(frame(spark, docs).repartition(3))) == want
    kept = {r.doc_id: r.kept for r in repeats.remove(frame(spark, docs)).collect()}
    assert all(hashlib.sha256(kept[d]).hexdigest() == w[3] for d, w in want.items())


def test_odd_rows(spark):
    text = "".join(random.Random(1).choices("abcdefgh ", k=3000)) * 40
    rows = [(1, None), (2, ""), (3, "short"), (None, text), (4, text), (4, text), (5, text)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove(frame(spark, rows)).collect())
    n = len(text)
    assert got == [(0, n, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 5, 0, 0), (4, n, n - 3000, 1), (4, n, n, 1), (5, n, n, 1)]
    assert repeats.remove(frame(spark, [])).count() == 0


def test_rows_of_one_doc_id_are_decided_apart(spark):
    x, y, z = ("".join(random.Random(k).choices("abcdefgh ", k=300)) for k in range(3))
    got = sorted((r.doc_id, bytes(r.kept).decode()) for r in repeats.remove(frame(spark, [(1, x), (2, x), (2, y)])).collect())
    assert got == sorted([(1, x), (2, ""), (2, y)])
    many = [(3, x + y)] * 30 + [(3, z), (4, y + z), (2, "short"), (2, "short")]
    out = repeats.remove(frame(spark, many).repartition(5)).collect()
    assert sum(r.n_removed for r in out) == 29 * 600 + 600
    assert sorted("".join(bytes(r.kept).decode() for r in out)) == sorted(x + y + z + "short" * 2)


def test_tables_are_in_the_shared_folder_and_go(spark):
    from quillmart.llm.common import _made, release

    before = {t.name for t in spark.catalog.listTables()}
    repeats.remove(frame(spark, [(1, "abc" * 90)])).collect()
    made = [name for kind, name in _made if kind == "table"]
    assert made and all(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") in str(spark.sql(f"DESCRIBE EXTENDED {t}").where("col_name = 'Location'").first().data_type) for t in made)
    release(spark)
    assert {t.name for t in spark.catalog.listTables()} <= before


def test_compared_is_the_same_however_frames_are_cut():
    draw = np.random.default_rng(2)
    f = pd.DataFrame({"kind": 0, "k1": draw.integers(0, 6, 60), "k2": draw.integers(0, 3, 60), "doc": draw.integers(0, 9, 60), "lo": draw.integers(0, 5, 60) * 1000, "n": 120})
    f = f.drop_duplicates(["k1", "k2", "doc", "lo"]).sort_values(["kind", "k1", "k2", "doc", "lo"]).reset_index(drop=True)

    def rows(cuts):
        parts = [f.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(f)], strict=True)]
        out = pd.concat(repeats._compared(iter(parts)))
        return {(k, d, x) for k, d, lo, n in out[["kind", "doc", "lo", "n"]].itertuples(index=False) for x in range(lo, lo + n)}

    whole = rows([])
    firsts = f.drop_duplicates(["k1", "k2"])
    several = firsts[firsts.groupby("k1")["k2"].transform("count") > 1]
    assert {(d, lo) for k, d, lo in whole if k == 2 and lo % 1000 == 0} == set(several[["doc", "lo"]].itertuples(index=False, name=None))
    for i in range(1, len(f)):
        assert rows([i]) == whole
    assert rows(list(range(1, len(f)))) == whole
