"""Repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered through their first ``LENGTH`` bytes only, most significant digit first, and equal groups are
the repeated windows. Instead of every suffix's own first bytes, the first digit is one that neighbouring windows
share: the least hash of the ``GRAM``-byte strings inside the window, the leftmost of equal ones. It depends on the
window's bytes alone, so equal windows have the same digit at the same place, and the windows of one place, some
forty in a row, travel as one row. A second digit, the hash of all bytes those windows cover, tells rows that are
equal throughout: of these, all but the earliest are repeats. A place whose first digit recurs with other bytes
around it goes one pass further, its windows in groups of ``STEP`` under the digits of what a group has in common and
of all that it covers; and where that is still undecided, one more: there each window stands alone under a 128-bit
digit of its whole depth.

Each pass first settles what repeats within a task's own batch, so a string found in any share of all documents
enters the exchange once a batch; the rest is streamed in sorted order with only the running group's first in
memory. Places whose first digit is unique leave after the first pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.llm.common import bucketed, stored, text_of, told_apart

LENGTH, GRAM, STEP, STEP_BYTES, BATCH_BYTES = 100, 20, 9, 2 << 20, 40 << 20
#: Bits of a place inside a text; the number of a text among those of its doc_id stands above them.
PLACE_BITS = 32
_ROWS = "kind byte, k1 long, k2 long, doc long, lo long, n long"
PLACE, SPAN, ASKED = 0, 1, 2


def _gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    n = len(data)
    eight = np.empty(n - 7, np.uint64)
    for o in range(min(8, n - 7)):
        count = (n - o) // 8
        eight[o::8] = np.frombuffer(data, "<u8", count, o)
    m = n - GRAM + 1
    h = eight[:m] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += eight[8 : m + 8]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += eight[GRAM - 8 : m + GRAM - 8]
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(30)
    return h


def _least_places(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the least of each ``w`` successive values, the leftmost of equal ones."""
    at = np.arange(len(h), dtype=np.int32)
    span = 1
    while span < w:
        step = min(span, w - span)
        later = h[step:] < h[:-step]
        at = np.where(later, at[step:], at[:-step])
        h = np.where(later, h[step:], h[:-step])
        span += step
    return at


def places(docs: list[tuple[int, int, bytes]], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(k1, k2, doc, lo, n): rows of windows that share their first digit; n bytes from lo on hold n - length + 1 windows.

    ``docs`` are (doc, the place its text starts at, text).
    """
    docs = [x for x in docs if len(x[2]) >= length]
    if not docs:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    data = b"".join(b for _, _, b in docs)
    size = np.array([len(b) for _, _, b in docs], np.int64)
    first = np.cumsum(size) - size
    h = _gram_hashes(data)
    at = _least_places(h, length - GRAM + 1)
    windows = size - length + 1
    s = np.arange(windows.sum()) + np.repeat(first - (np.cumsum(windows) - windows), windows)
    place = at[s]
    starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (s[1:] != s[:-1] + 1)]))
    lo, hi = s[starts], s[np.append(starts[1:], len(s)) - 1] + length
    digest = xxhash.xxh3_64_intdigest
    k2 = np.fromiter((digest(data[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)), np.uint64, len(lo)).view(np.int64)
    k = np.searchsorted(first, lo, side="right") - 1
    doc, base = (np.array([x[i] for x in docs], np.int64)[k] for i in (0, 1))
    return h[place[starts]].view(np.int64), k2, doc, lo - first[k] + base, hi - lo


def _frame(kind: int, doc, lo, n, k1=None, k2=None) -> pd.DataFrame:
    zero = np.zeros(len(doc), np.int64)
    # a settled span goes anywhere, evenly
    k1 = (np.asarray(doc) * np.int64(0x9E3779B97F4A7C1) ^ np.asarray(lo)) if k1 is None else k1
    return pd.DataFrame({"kind": np.full(len(doc), kind, np.int8), "k1": k1, "k2": zero if k2 is None else k2, "doc": doc, "lo": lo, "n": n})


def merged(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of a document as one; where one starts later it ends later."""
    if not len(doc):
        return doc, lo, n
    order = np.lexsort((n, lo, doc))
    doc, lo, end = doc[order], lo[order], (lo + n)[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] > end[:-1])]))
    last = np.append(new[1:], len(doc)) - 1
    return doc[new], lo[new], end[last] - lo[new]


def _settled(k1, k2, doc, lo, n) -> Iterator[pd.DataFrame]:
    """What a batch knows by itself: the first row of each (k1, k2) goes on, the others are repeats."""
    if not len(k1):
        return
    order = np.lexsort((lo, doc, k2, k1))
    k1, k2, doc, lo, n = (x[order] for x in (k1, k2, doc, lo, n))
    new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(k1)), 0))
    again = (doc != doc[first]) | (lo != lo[first])
    yield _frame(PLACE, doc[new], lo[new], n[new], k1[new], k2[new])
    yield _frame(SPAN, *merged(doc[again], lo[again], n[again]))


def _compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted by kind, k1, k2, doc, lo: repeats as SPAN rows, and as ASKED rows the first of each (k1, k2) whose k1 has others."""
    c = None  # k1, k2, doc and lo of the running group's first row, groups of k1 so far, its first group's row
    for f in frames:
        ready = f[f["kind"] == SPAN]
        if len(ready):
            yield ready
        f = f[f["kind"] == PLACE]
        if not len(f):
            continue
        k1, k2, doc, lo, n = (f[x].to_numpy() for x in ("k1", "k2", "doc", "lo", "n"))
        at = np.arange(len(f))
        new1 = np.concatenate([[c is None or k1[0] != c[0]], k1[1:] != k1[:-1]])
        new2 = new1 | np.concatenate([[c is None or k2[0] != c[1]], k2[1:] != k2[:-1]])
        first = np.maximum.accumulate(np.where(new2, at, -1))
        own = first >= 0
        fdoc, flo = np.where(own, doc[first], c[2] if c else 0), np.where(own, lo[first], c[3] if c else 0)
        again = (doc != fdoc) | (lo != flo)
        yield _frame(SPAN, *merged(doc[again], lo[again], n[again]))
        head = np.maximum.accumulate(np.where(new1, at, -1))
        so_far = np.cumsum(new2)
        order = np.where(head >= 0, so_far - so_far[head] + 1, so_far + (c[4] if c else 0))
        late = new2 & (order >= 2)
        second = head[new2 & (order == 2)]
        asked = np.union1d(at[late], second[second >= 0])
        yield _frame(ASKED, doc[asked], lo[asked], n[asked])
        if (second < 0).any():
            yield _frame(ASKED, *(np.array([x]) for x in c[5]))
        row = (doc[head[-1]], lo[head[-1]], n[head[-1]]) if head[-1] >= 0 else c[5]
        c = (k1[-1], k2[-1], fdoc[-1], flo[-1], int(order[-1]), row)


def _pass(rows: DataFrame) -> DataFrame:
    return rows.repartition("k1").sortWithinPartitions("kind", "k1", "k2", "doc", "lo").mapInPandas(_compared, _ROWS)


def _first_pass(docs: DataFrame, length: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got, size = [], 0
        step, n = [], 0
        for f in frames:
            for d, base, t in zip(f["doc"].tolist(), f["base"].tolist(), f["text"], strict=True):
                b = t.encode("utf-8", "surrogatepass")
                step.append((d, base, b))
                n += len(b)
                if n >= STEP_BYTES:
                    got.append(places(step, length))
                    size, step, n = size + n, [], 0
                if size >= BATCH_BYTES:
                    yield from _settled(*(np.concatenate(x) for x in zip(*got, strict=True)))
                    got, size = [], 0
        got.append(places(step, length))
        yield from _settled(*(np.concatenate(x) for x in zip(*got, strict=True)))

    return docs.mapInPandas(run, _ROWS)


def _by_text(rows: DataFrame, keys: list[str], **lists) -> DataFrame:
    """``lists`` gathered by text; ``lo`` counts from the text's own start there."""
    base = F.col("lo").bitwiseAND(F.lit(-1 << PLACE_BITS))
    return rows.withColumns({"base": base, "lo": F.col("lo") - base}).groupBy(*keys).agg(*(v.alias(k) for k, v in lists.items()))


def _texts_of(table: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    found = _by_text(asked, keys, at=F.collect_set(F.struct("lo", "n")))
    return table.join(found, keys).select("doc", "base", "text", F.col("at.lo").alias("los"), F.col("at.n").alias("ns"))


def parts(docs: list[int], los: list[int], spans: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(k1, k2, doc, lo, n): the windows of each span in groups of ``STEP`` successive starts, counted from the span's own place.

    A group's windows all hold the bytes that the first digit is made of, whichever of them the span has; the second
    is made of all that those cover and where they start. So a first digit that stands alone means that none recurs.
    """
    most = length - GRAM
    data, size = b"".join(spans), np.array([len(b) for b in spans], np.int64)
    first = np.cumsum(size) - size
    lo = np.array(los, np.int64)
    # where the place lies, as a start relative to the earliest window that can have it
    rel = most - _gram_hashes(data)[first[:, None] + np.arange(most + 1)].argmin(1)
    g0, g1 = rel // STEP, (rel + size - length) // STEP
    k = np.repeat(np.arange(len(lo)), g1 - g0 + 1)
    g = np.arange(len(k)) - np.repeat(np.cumsum(g1 - g0 + 1) - (g1 - g0 + 1), g1 - g0 + 1) + g0[k]
    origin = first[k] - rel[k]
    s0, s1 = np.maximum(first[k], origin + g * STEP), np.minimum(first[k] + size[k] - length, origin + g * STEP + STEP - 1)
    core = origin + np.minimum(g * STEP + STEP - 1, most)
    digest = xxhash.xxh3_64_intdigest
    k1 = np.fromiter((digest(data[a:b], i) for a, b, i in zip(core.tolist(), (origin + g * STEP + length).tolist(), g.tolist(), strict=True)), np.uint64, len(k))
    k2 = np.fromiter((digest(data[a : b + length], i) for a, b, i in zip(s0.tolist(), s1.tolist(), (s0 - origin).tolist(), strict=True)), np.uint64, len(k))
    return k1.view(np.int64), k2.view(np.int64), np.array(docs, np.int64)[k], lo[k] + s0 - first[k], s1 - s0 + length


def _middle_pass(table: DataFrame, asked: DataFrame, keys: list[str], length: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, starts, spans, got, size = [], [], [], [], 0
        for f in frames:
            for d, base, t, los, ns in f.itertuples(index=False):
                b = t.encode("utf-8", "surrogatepass")
                for a, n in zip(np.asarray(los).tolist(), np.asarray(ns).tolist(), strict=True):
                    docs.append(d)
                    starts.append(base + a)
                    spans.append(b[a : a + n])
                if len(spans) > 8_000:
                    got.append(parts(docs, starts, spans, length))
                    docs, starts, spans, size = [], [], [], size + len(got[-1][0])
                if size > 600_000:
                    yield from _settled(*(np.concatenate(x) for x in zip(*got, strict=True)))
                    got, size = [], 0
        if spans:
            got.append(parts(docs, starts, spans, length))
        if got:
            yield from _settled(*(np.concatenate(x) for x in zip(*got, strict=True)))

    return _texts_of(table, asked, keys).mapInPandas(run, _ROWS)


def _last_pass(table: DataFrame, asked: DataFrame, keys: list[str], length: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digits, doc, lo = [], [], []
        digest = xxhash.xxh3_128_digest
        for f in frames:
            for d, base, t, los, ns in f.itertuples(index=False):
                b = t.encode("utf-8", "surrogatepass")
                for a, n in zip(np.asarray(los).tolist(), np.asarray(ns).tolist(), strict=True):
                    digits.extend(digest(b[s : s + length]) for s in range(a, a + n - length + 1))
                    lo.extend(range(base + a, base + a + n - length + 1))
                    doc.extend([d] * (n - length + 1))
                if len(lo) > 400_000:
                    yield from _flush(digits, doc, lo, length)
                    digits, doc, lo = [], [], []
        yield from _flush(digits, doc, lo, length)

    return _texts_of(table, asked, keys).mapInPandas(run, _ROWS)


def _flush(keys: list[bytes], doc: list[int], lo: list[int], length: int) -> Iterator[pd.DataFrame]:
    k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    d, s = np.array(doc, np.int64), np.array(lo, np.int64)
    yield from _settled(k[:, 0].copy(), k[:, 1].copy(), d, s, np.full(len(d), length, np.int64))


def spans(table: DataFrame, keys: list[str], length: int = LENGTH) -> DataFrame:
    """doc, lo, n: spans of ``table(doc, base, text)`` that earlier strings of ``length`` bytes cover; they may overlap.

    A text's places count from ``base``; ``keys`` tell its texts apart: doc, and base where a doc has several.
    """
    asked = lambda rows: rows.where(F.col("kind") == ASKED).select("doc", "lo", "n")
    first = stored(_pass(_first_pass(table, length)), "places")
    middle = stored(_pass(_middle_pass(table, asked(first), keys, length)), "parts")
    last = stored(_pass(_last_pass(table, asked(middle), keys, length)), "windows")
    return first.union(middle).union(last).where(F.col("kind") == SPAN).select("doc", "lo", "n")


def remove(docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` the remaining bytes as ``kept``.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a smaller doc_id or earlier in the
    same document, judged on the input. A null text is empty. Rows of a repeated doc_id are documents of their own, the
    later ones after the first, in the order in which they are read. Rows with a null doc_id take no part and stay
    whole. Texts are read whole, whatever their length; other columns are ignored; an empty table gives no rows.
    """
    rows, again = told_apart(docs.select(F.col("doc_id").cast("long").alias("doc"), text_of().alias("text")), "doc", "base")
    rows = rows.withColumn("base", F.shiftleft("base", PLACE_BITS))
    keys = ["doc", "base"] if again else ["doc"]
    table = bucketed(rows.where("doc is not null"), "doc", "repeats")
    by_text = _by_text(spans(table, keys, length), keys, los=F.collect_list("lo"), ends=F.collect_list(F.col("lo") + F.col("n")))
    joined = table.join(by_text, keys, "left").unionByName(rows.where("doc is null"), allowMissingColumns=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for d, t, los, ends in f[["doc", "text", "los", "ends"]].itertuples(index=False):
                b = t.encode("utf-8", "surrogatepass")
                kept, at, gone, count = [], 0, 0, 0
                if los is not None:
                    until = -1
                    for a, e in sorted(zip(los, ends, strict=True)):
                        a, e = min(a, len(b)), min(e, len(b))
                        if a > until:
                            kept.append(b[at:a])
                            count += a < e
                        if e > max(until, a):
                            gone += e - max(until, a)
                        until = at = max(until, e)
                rest = b"".join([*kept, b[at:]])
                out.append((d, len(b), gone, count, hashlib.sha256(rest).hexdigest(), rest))
            got = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})
            yield got if with_text else got.drop(columns="kept")

    return joined.select("doc", "text", "los", "ends").mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
