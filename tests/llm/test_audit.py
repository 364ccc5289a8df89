import itertools
import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from quillmart.llm import audit, queries

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import differences  # noqa: E402

WORDS = re.compile("[^\x20\x09-\x0d]+")
ODD = ["", " ", "a", " a", "a ", "\t\n\x0b\x0c\r ", "a\x00b \x00", "a\x1cb\x85c d e", "É A É a", "日本 日本 日", "#", "x" * 300 + " " + "x" * 300 + " " + "x" * 299 + "y", "ab" * 40 + " " + "ab" * 39 + "ac " + "ab" * 40, "𝒳𝒴 A", "abcdefgh abcdefgh abcdefgi abcdefghi abcdefghj abcdefgh\x00"]


def brute(t):
    w = WORDS.findall(t)
    return [len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall(r"[#$%&*|]", t))]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_facts_against_plain_python(monkeypatch, spark, sf, kind):
    texts = ODD + [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD[::-1]
    want = [brute(t) for t in texts]
    for step, part in ((1 << 20, 1 << 20), (500, 7), (50_000, 1000)):
        monkeypatch.setattr(audit, "STEP", step)
        monkeypatch.setattr(audit, "SLICE", part)
        assert audit.facts_of(pa.array(texts, kind)).tolist() == want
        assert audit.facts_of(pa.array(["zz", *texts, "zz"], kind)[1:-1]).tolist() == want
    assert audit.facts_of(pa.array([], kind)).shape == (0, 5)


def test_words_of_equal_hash_are_told_apart():
    data = np.frombuffer(b"aa bb aa cc dd dd", np.uint8)
    total, starts, ends = audit.counts(data, np.array([0, 9, 17]))
    first = np.searchsorted(starts, [0, 9, 17])
    alike = lambda d, s, n: np.zeros(len(s), np.uint64)
    assert audit.distinct_words(data, starts, ends - starts, first, alike).tolist() == [2, 2]
    assert audit.distinct_words(data, starts, ends - starts, first).tolist() == [2, 2]


def test_op11_against_sql(spark, sf):
    assert differences(queries.op11_filter_audit(spark, sf), queries.OP11_SQL, sf) == []


def simulated(rows, good, toxic):
    """Every order run document by document."""
    failing, out = {}, {}
    for i, (doc_id, text, lang) in enumerate(rows):
        w, d, c, p, s = brute(text or "")
        repeat = doc_id is not None and any(o is not None and o < doc_id and (t or "") == (text or "") for o, t, _ in rows)
        failing[i] = {k for k, f in zip("ABCDE", (w < 100, 100 * d < 80 * w, 100 * c > 10 * p, s > 0, repeat), strict=True) if f}
    for part in {r[2] or "" for r in rows}:
        own = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in failing[i]]
                left = [i for i in left if f not in failing[i]]
                redundant = sum(f in failing[i] for i in own) - len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(failing[i] == {f} for i in own), sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone)]
                shapley[f] += len(gone)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(shapley[f])
    return out


def test_op11_odd_rows_against_a_simulation(spark):
    long = " ".join(f"w{i}" for i in range(150))
    rows = [(1, long, "en"), (2, long, "en"), (2, long, "en"), (3, "a a a #", None), (4, None, ""), (5, "", "de"), (None, long, "en"), (None, None, None), (6, "LOUD " * 200, "en"), (6, "x", "en"), (7, "word " * 60_000, "de"), (0, "x", "fr")]
    docs = spark.createDataFrame([(*r, "n", 3) for r in rows], "doc_id long, text string, lang string, n string, mask int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 0, None), (None, 1, 1), (6, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = audit.audit(docs.repartition(3), labels).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == simulated(rows, {1, 2}, {2, 6})
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert audit.audit(docs, labels.limit(0)).count() == len(got)
