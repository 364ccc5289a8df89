import os
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quillmart.llm import encoding, packing, quality, queries, token_files
from quillmart.llm.common import scratch
from quillmart.llm.encoding import Chunks

ODD = ["", " ", "\n", "\n\n", "a  b", " a b", "a \n b\n", "\na", "a\n", "a ", "a\tb c", "don't I'll", "<|endoftext|> a", "<|ENDOFTEXT|>", "a\r\nb", "a\x1cb \x1c c", "é é a ́b", "日本語 テスト", "\n a", " \na", "a\x00 \x00b", "\x00x", "İstanbul ΟΔΟΣ. x²", "word " * 3000]
DOCS = "doc_id long, text string, start string, ids_crc32 string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunks_give_the_librarys_ids(spark, sf, name, spaces):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    c = Chunks(public_tokenizers.path(name), spaces)
    for t, got in zip(texts, c.each(texts), strict=True):
        assert c.library.encode(t, add_special_tokens=False).ids == got.tolist(), repr(t[:50])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2_round_trip(spark, sf):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in queries.op2_token_files(spark, sf).collect()}
    start = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_op2_nulls_repeats_and_empty(spark):
    path = scratch(spark, "t")
    token_files.write(frame(spark, [(5, None), (2, ""), (2, ""), (None, "a b"), (1, "x " * 5000)]), path, public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted((r.start, r.doc_id, r.n_tokens, r.tokens) for r in token_files.read(spark, path).collect())
    assert [(r[0], r[1], r[2]) for r in rows] == [(0, None, 3), (3, 1, 5001), (5004, 2, 1), (5005, 2, 1), (5006, 5, 1)]
    assert all(r[3][-1] == 1 for r in rows)
    path = scratch(spark, "t")
    token_files.write(frame(spark, []), path, public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.digest_rows(spark, path).count() == 0


def test_op2_files_are_laid_out_for_selective_reads(spark, sf):
    path = scratch(spark, "t")
    token_files.write(spark.read.parquet(f"{sf}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), parts=2)
    files = sorted(Path(path.removeprefix("file://")).glob("part-*.parquet"))
    assert len(files) == 2
    last = None
    for f in files:
        groups = pq.ParquetFile(f).metadata
        for g in range(groups.num_row_groups):
            columns = {(c := groups.row_group(g).column(i)).path_in_schema: c for i in range(groups.num_columns)}
            assert groups.row_group(g).total_byte_size <= 1.2 * token_files.ROW_GROUP
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
            assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
            for name in ("doc_id", "place", "n_tokens"):
                assert "DELTA_BINARY_PACKED" in columns[name].encodings
            low, high = columns["doc_id"].statistics.min, columns["doc_id"].statistics.max
            assert last is None or low >= last  # files and row groups in order: a doc_id is in one or two of them
            last = high
    counts = spark.read.parquet(path).select("n_tokens")
    assert "<tokens" not in str(counts._jdf.queryExecution().executedPlan()).split("ReadSchema")[1]


def test_the_memory_of_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr(encoding, "LIMIT", 2_000)
    monkeypatch.setattr(encoding, "PART", 50)
    c = Chunks(public_tokenizers.path("word_bpe_49k.json"), False)
    texts = [f"word{i} and again" for i in range(300)]
    assert [x.tolist() for x in c.each(texts)] == [c.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert c.weight < 4_000 and len(c.known) < 20


def test_op5_each_id_once(spark, sf):
    check_pack(spark, spark.read.parquet(f"{sf}/documents.parquet"), queries.op5_cost_balanced_packing(spark, sf))


def check_pack(spark, docs, got):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    left, sequences, rows = {d: len(x) for d, x in ids.items()}, {}, got.collect()
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
        left[r.doc_id] -= r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert not any(left.values())
    assert len({(r.doc_id, r.start) for r in rows}) == len(rows)
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    assert sum(1024 - sum(n for _, n in s) for s in sequences.values()) < 1024 * got.rdd.getNumPartitions()


def test_op5_odd_rows(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "a"), (4, "long word " * 4000)])
    check_pack(spark, docs, packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))
    twice = packing.pack(frame(spark, [(1, "a b"), (1, "a b"), (None, "c")]), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted(r.length for r in twice) == [2, 3, 3]
    assert packing.pack(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


_PEAK = """
import random, re, sys, threading, time, types
import pyarrow as pa, public_tokenizers
from quillmart.llm import encoding, packing

def now():
    return int(re.search(r"Pss_Anon: +([0-9]+)", open("/proc/self/smaps_rollup").read())[1]) >> 10

def watch():
    while True:
        peak.append(now())
        time.sleep(0.02)

path = public_tokenizers.path("byte_bpe_50k.json")
encoding.chunks(path, True)
draw = random.Random(4)
words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randrange(3, 10))) for _ in range(60_000)]
batch = pa.record_batch({"doc_id": list(range(10_000)), "text": [" ".join(draw.choices(words, k=450)) for _ in range(10_000)]})
del words
runs = []
packing.TaskContext = types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0))
packing.text_of = lambda: types.SimpleNamespace(alias=lambda name: None)
rows = types.SimpleNamespace(mapInPandas=lambda run, schema: runs.append((run, pa.RecordBatch.to_pandas)), mapInArrow=lambda run, schema: runs.append((run, lambda b: b)))
class Docs:
    def __getitem__(self, name):
        return types.SimpleNamespace(cast=lambda kind: types.SimpleNamespace(alias=lambda name: None))
    def select(self, *columns):
        return rows
packing.pack(Docs(), path)
run, given = runs[0]
pa.default_memory_pool().release_unused()
pa.system_memory_pool().release_unused()
peak = [before := now()]
threading.Thread(target=watch, daemon=True).start()
pieces = sum(len(f) if hasattr(f, "iloc") else f.num_rows for f in run(map(given, [batch])))
print(pieces, max(peak) - before)
"""


def test_packing_takes_little_memory_beside_its_batch():
    """One worker, a batch of 10,000 texts: the MB it takes beside them, at most, while it packs them."""
    out = subprocess.run([sys.executable, "-c", _PEAK], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    pieces, more = map(int, out.stdout.split()) if out.stdout else pytest.fail(out.stderr)
    assert pieces > 10_000 and more < 75


def test_assign_goes_to_the_lowest_cost():
    got = packing.assign([6, 5, 4, 3, 2], capacity=10)
    assert got == [[(0, 6)], [(1, 5)], [(1, 4)], [(0, 3)], [(1, 1), (0, 1)]]


def test_sum_of_squares_identity():
    m = quality.Machine(3)
    m.v *= 30
    slots, x = quality.features("Some words, some MORE words!!\nand 12 digits")
    z, _ = m.raw(slots, x)
    brute = sum(float(m.v[a] @ m.v[b]) * x[i] * x[j] for i, a in enumerate(slots) for j, b in enumerate(slots) if i < j)
    assert z == pytest.approx(m.w0 + float(m.w[slots] @ x) + brute)


def test_op1_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op1_factorisation_machine(spark, d).collect()}
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows.values())
    held = [(r.quality, rows[r.doc_id]) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert sum(y == r.predicted for y, r in held) / len(held) > 0.95


def test_op1_odd_rows(spark):
    docs = frame(spark, [(1, None), (2, ""), (2, "x"), (None, "a b"), (4, "ab! " * 9000)])
    labels = spark.createDataFrame([(1, None), (2, 1), (None, 0), (4, 0), (4, 0)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert quality.classify(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_a_word_is_encoded_once_whatever_follows_it(name, spaces):
    """Punctuation, and capitals where they don't count, cost no call; nor does a word met again after the memory has turned over."""
    c = Chunks(public_tokenizers.path(name), spaces)
    asked = []
    add = c._add_words
    c._add_words = lambda words: (asked.extend(words), add(words))[1]
    texts = ["so, Élan anor; anor. anor:, «anor» x-y\nElan, elan Anor!? 3rd\nanor"] * 2
    for t, got in zip(texts, c.each(texts), strict=True):
        assert c.library.encode(t, add_special_tokens=False).ids == got.tolist()
    c.old, c.memory = c.memory, encoding._Memory()
    assert next(c.each(texts)).tolist() == c.library.encode(texts[0], add_special_tokens=False).ids
    assert asked.count("anor") == 1 and len(asked) == len(set(asked))


def test_op5_words_that_open_lines_need_no_whole_call(monkeypatch):
    """After a line break a word is merged as it stands; only other chunks go through the whole library."""
    c = Chunks(public_tokenizers.path("byte_bpe_50k.json"), True)
    texts = ["First line, of words.\nSecond: and\nÉlan\nlast.", "\nopen", "First\n3rd x-y\n?!"]
    want = [c.library.encode(t, add_special_tokens=False).ids for t in texts]
    asked = []
    whole = c.library

    class Counted:
        model = whole.model

        def encode_batch_fast(self, x, **k):
            asked.extend(x)
            return whole.encode_batch_fast(x, **k)

    c.library = Counted()
    assert [x.tolist() for x in c.each(texts)] == want
    assert not [x for x in asked if x.strip().rstrip(".,:").isalpha()]
