"""Interaction audit of corpus filters, by scanning Arrow buffers.

A document's bytes are never made into strings: one table gives every byte its classes, prefix sums over them give
each document's counts at its bounds, and the places where the word class changes give its words. A word's hash is
made from eight bytes at a time, hashes are sorted within each document, and neighbours of equal hash are compared
byte by byte; a document in which two words share a hash is counted anew from the words themselves. So all counts
are exact.

Each document then is a mask of the filters it fails. Documents are counted by part and mask, 32 counts a part at
most, and every order of the filters is read off those counts; no order is ever run.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.llm.common import stored, text_of

WORD, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8
FILTERS = "ABCDE"
#: Documents are taken together up to STEP bytes, and bytes SLICE at a time; words of over LONG bytes one by one.
STEP, SLICE, LONG = 1 << 20, 1 << 20, 256


def _classes() -> np.ndarray:
    b = np.arange(256)
    word = (b != 0x20) & ((b < 0x09) | (b > 0x0D))
    capital = (b >= ord("A")) & (b <= ord("Z"))
    return (WORD * word + CAPITAL * capital + POINT * ((b & 0xC0) != 0x80) + SYMBOL * np.isin(b, list(b"#$%&*|"))).astype(np.uint8)


CLASSES = _classes()
#: Three counts in one number, 21 bits each: capitals, code points, symbols.
_LANES = (((CLASSES & CAPITAL) != 0).astype(np.int64) << 42) + (((CLASSES & POINT) != 0).astype(np.int64) << 21) + ((CLASSES & SYMBOL) != 0)
_LOW = [(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1]
_MASKS = np.array(_LOW, np.uint64)


@dataclass(frozen=True)
class Limits:
    """Fewer than ``words`` words; fewer distinct ones than ``distinct`` per cent; over ``capitals`` per cent of capitals."""

    words: int = 100
    distinct: int = 80
    capitals: int = 10


def counts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(three counts a document: capitals, code points, symbols; first and end places of all words) of adjacent documents."""
    total = np.zeros((3, len(bounds) - 1), np.int64)
    starts, ends, before = [], [], False
    for a in range(0, len(data), SLICE):
        part = data[a : a + SLICE]
        sums = np.concatenate([[0], np.cumsum(_LANES[part])])
        i, j = np.searchsorted(bounds, a, side="right") - 1, np.searchsorted(bounds, a + len(part), side="left")
        at = sums[np.clip(bounds[i : j + 1], a, a + len(part)) - a]
        own = at[1:] - at[:-1]
        for lane, shift in enumerate((42, 21, 0)):
            total[lane, i:j] += (own >> shift) & ((1 << 21) - 1)
        word = (CLASSES[part] & WORD).view(bool)
        last = np.concatenate([[before], word[:-1]])
        opens = np.zeros(len(part), bool)
        opens[bounds[i : j + 1][(bounds[i : j + 1] >= a) & (bounds[i : j + 1] < a + len(part))] - a] = True
        starts.append(np.flatnonzero(word & (~last | opens)) + a)
        ends.append(np.flatnonzero(last & (~word | opens)) + a)
        before = bool(word[-1])
    ends.append(np.array([len(data)] if before else [], np.int64))
    return total, np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate(ends)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))


def _mixed(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    h = (h ^ v) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    eight = _eights(data)
    h = _mixed(sizes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9), eight[starts] & _MASKS[np.minimum(sizes, 8)])
    at, k = np.flatnonzero((sizes > 8) & (sizes <= LONG)), 8
    while len(at):
        h[at] = _mixed(h[at], eight[starts[at] + k] & _MASKS[np.minimum(sizes[at] - k, 8)])
        k += 8
        at = at[sizes[at] > k]
    for i in np.flatnonzero(sizes > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _same(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a[i] and b[i] are the same bytes."""
    eight = _eights(data)
    same = sizes[a] == sizes[b]
    same &= ((eight[starts[a]] ^ eight[starts[b]]) & _MASKS[np.minimum(sizes[a], 8)]) == 0
    at, k = np.flatnonzero(same & (sizes[a] > 8) & (sizes[a] <= LONG)), 8
    while len(at):
        differs = ((eight[starts[a[at]] + k] ^ eight[starts[b[at]] + k]) & _MASKS[np.minimum(sizes[a[at]] - k, 8)]) != 0
        same[at[differs]] = False
        k += 8
        at = at[~differs & (sizes[a[at]] > k)]
    for i in np.flatnonzero(same & (sizes[a] > LONG)).tolist():
        same[i] = np.array_equal(data[starts[a[i]] : starts[a[i]] + sizes[a[i]]], data[starts[b[i]] : starts[b[i]] + sizes[b[i]]])
    return same


def distinct_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, hashes=word_hashes) -> np.ndarray:
    """Distinct words of each document; document d has the words from first[d] to first[d + 1]."""
    n = len(first) - 1
    if not len(starts):
        return np.zeros(n, np.int64)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    key = (doc << (np.uint64(64) - bits)) | (hashes(data, starts, sizes) >> bits)
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    out = np.bincount((key[new] >> (np.uint64(64) - bits)).astype(np.int64), minlength=n)
    again = np.flatnonzero(~new)
    wrong = again[~_same(data, starts, sizes, order[again - 1], order[again])]
    for d in np.unique((key[wrong] >> (np.uint64(64) - bits)).astype(np.int64)).tolist():
        own = range(first[d], first[d + 1])
        out[d] = len({data[starts[i] : starts[i] + sizes[i]].tobytes() for i in own})
    return out


def facts_of(texts: pa.Array) -> np.ndarray:
    """words, distinct words, capitals, code points, symbols: a row of five for each text of an Arrow array without nulls."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros((0, 5), np.int64)
    offsets = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    out, i = [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP, side="right")) - 1)
        part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        total, starts, ends = counts(part, bounds)
        first = np.searchsorted(starts, bounds)
        out.append(np.stack([np.diff(first), distinct_words(part, starts, ends - starts, first), *total], 1))
        i = j
    return np.concatenate(out)


def failures(facts: np.ndarray, limits: Limits = Limits()) -> np.ndarray:
    """Bits of the filters A to D that each row of ``facts_of`` fails."""
    words, distinct, capitals, points, symbols = facts.T
    fails = (words < limits.words, 100 * distinct < limits.distinct * words, 100 * capitals > limits.capitals * points, symbols > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def scanned(docs: DataFrame, limits: Limits = Limits(), part: str = "lang") -> DataFrame:
    """doc_id, part, text_sha256, n_words, n_distinct, n_capitals, n_points, n_symbols, mask (of A to D) of every row.

    A null text or part is empty. Texts are read whole; a batch is scanned about a megabyte of documents at a time,
    so memory grows with a batch and its longest text only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            facts = facts_of(b.column(2))
            hashes = pa.array([hashlib.sha256(t.as_buffer()).digest() for t in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), hashes, *(pa.array(c) for c in facts.T), pa.array(failures(facts, limits))], names=names)

    names = ["doc_id", "part", "text_sha256", "n_words", "n_distinct", "n_capitals", "n_points", "n_symbols", "mask"]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(part).alias("part"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, text_sha256 binary, n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long, mask int")


def orders() -> list[dict]:
    """Every order and step of it: the step's filter as a bit, and those before it."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            out.append({"filter_order": "".join(FILTERS[i] for i in order), "step": step, "own": 1 << k, "before": before})
            before |= 1 << k
    return out


def masks(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of filters they fail; see ``audit``."""
    facts = stored(scanned(docs, limits, part).select("doc_id", "part", "text_sha256", "mask"), "facts")
    rows = facts.groupBy("text_sha256", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    # the least doc_id of a text is met again by text and doc_id, so a text that many share is in no one's task
    first = facts.where(F.col("doc_id").isNotNull()).groupBy("text_sha256").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    rows = rows.join(first, ["text_sha256", "doc_id"], "left")
    repeats = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = rows.withColumn("mask", F.col("mask").bitwiseOR(F.when(repeats, 16).otherwise(0))).join(known, "doc_id", "left")
    marked = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), marked("good"), marked("toxic"))


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), part: str = "lang") -> DataFrame:
    """How five filters act together, in every order: one row per part, order and step.

    A fails texts of too few words, B of too few distinct ones, C of too many capitals, D of any of ``#$%&*|``, and E
    those whose text a smaller doc_id has, in any part. Returns part, filter_order, step and, counted within the part,
    kept (after the step), removed (by it), redundant (failing its filter but removed before), unique_fails (failing
    no other), good_lost and toxic_lost (removed by it with labels quality or toxic 1), shapley (removed by the
    filter, over all orders).

    A null text or part counts as empty. Rows of a repeated doc_id are documents of their own that share its labels,
    and neither makes the other a repeat; a doc_id labelled more than once is good or toxic if any of its labels is. A
    null doc_id has no labels and is neither a repeat nor makes one. Other columns are ignored; an empty table has no
    parts and gives no rows.
    """
    by_part = masks(docs, labels, limits, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    schema = "array<struct<filter_order: string, step: int, own: int, before: int>>"
    rows = by_part.select("part", "masks", F.inline(F.from_json(F.lit(json.dumps(orders())), schema)))
    own, before = F.col("own"), F.col("before")

    def total(value, keep):
        return F.aggregate(F.filter("masks", keep), F.lit(0).cast("long"), lambda x, m: x + value(m))

    n = lambda m: m["n"]
    fails = lambda m: m["mask"].bitwiseAND(own) != 0
    gone = lambda m: m["mask"].bitwiseAND(before) != 0
    removed = lambda m: fails(m) & ~gone(m)
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(n, lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(n, removed).alias("removed"),
        total(n, lambda m: fails(m) & gone(m)).alias("redundant"),
        total(n, lambda m: m["mask"] == own).alias("unique_fails"),
        total(lambda m: m["good"], removed).alias("good_lost"),
        total(lambda m: m["toxic"], removed).alias("toxic_lost"),
        # of the filters that a document fails, each comes first in as many orders
        total(lambda m: m["n"] * (F.lit(120) / F.bit_count(m["mask"])).cast("long"), fails).alias("shapley"),
    )
