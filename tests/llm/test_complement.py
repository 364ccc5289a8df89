import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillmart.llm import complement, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, got, room=2048):
    """Each id in one piece, cut as the contract says, and no gap in a sequence; returns (sequences, tokens)."""
    t = Tokenizer.from_file(PATH)
    want = Counter()
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), room)):
            own = ids[s : s + room]
            want[r.doc_id, p, s, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    rows = got.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= room
    return len(sequences), sum(r.length for r in rows)


def test_op12_each_piece_once_in_few_sequences(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, tokens = check(docs, queries.op12_exact_complements(spark, sf))
    assert n <= -(-tokens // 2048) + docs.rdd.getNumPartitions()


def test_op12_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "long word " * 4000), (4, "b"), (4, "b"), (None, "c"), (5, "a " * 2047), (6, "a " * 2048)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, piece string, ids string")
    check(docs, complement.pack(docs, PATH))
    check(docs, complement.pack(docs, PATH, block_tokens=100))
    whole = complement.pack(docs, PATH).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in whole)
    assert complement.pack(docs.limit(0), PATH).count() == 0


def fewest(lengths, room):
    """The least number of bins, by search over all packings."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0] and not (i == len(lengths) and len(bins) < best[0]):
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for r in {*bins}:
            if r >= lengths[i]:
                rest = list(bins)
                rest.remove(r)
                place(i + 1, [*rest, r - lengths[i]])
        place(i + 1, [*bins, room - lengths[i]])

    place(0, [])
    return best[0]


def test_plans_against_all_packings():
    rng = random.Random(3)
    for _ in range(150):
        room = rng.choice([6, 10, 16])
        lengths = [rng.randint(1, room) for _ in range(rng.randint(1, 9))]
        got = complement.planned(lengths, room)
        assert Counter(n for b in got for n in b) == Counter(lengths)
        assert all(sum(b) <= room for b in got)
        assert len(got) <= fewest(lengths, room) + 1
        assert len(got) <= len(complement.best_fit(lengths, room))


def combinations(count, total):
    for k in (1, 2, 3):
        found = [c for c in _sums(count, total, k)]
        if found:
            return max(found)
    return None


def _sums(count, total, k, most=None):
    most = total if most is None else most
    if k == 1:
        if 0 < total <= most and count[total]:
            yield (total,)
        return
    for a in range(min(most, total - 1), 0, -1):
        if count[a]:
            count[a] -= 1
            for rest in list(_sums(count, total - a, k - 1, a)):
                yield (a, *rest)
            count[a] += 1


def test_complements_against_every_combination():
    rng = random.Random(5)
    for _ in range(40):
        room = rng.choice([8, 20, 33])
        count = [0] + [rng.choice([0, 0, 1, 1, 2, 5]) for _ in range(room)]
        index = complement.Sums(count)
        for _ in range(60):
            total = rng.randint(1, room)
            want = combinations(list(count), total)
            got = index.take(total)
            assert (got is None) == (want is None)
            if got is not None:
                assert sum(got) == total and len(got) == len(want)
        assert min(count) >= 0


@pytest.mark.parametrize(("low", "high"), [(1, 2047), (600, 2047), (1, 300), (700, 700)])
def test_never_more_than_best_fit(low, high):
    rng = random.Random(low)
    lengths = [rng.randint(low, high) for _ in range(4000)]
    got = complement.planned(lengths)
    assert Counter(n for b in got for n in b) == Counter(lengths) and max(map(sum, got)) <= 2048
    assert len(got) <= len(complement.best_fit(lengths, 2048))
    if high <= 300:
        assert len(got) == -(-sum(lengths) // 2048)
