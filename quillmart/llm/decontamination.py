"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-cased words joined by single spaces. An item of m characters may differ by
k = floor(rate * m) edits; cut into k + 1 pieces, at least one piece of it stands unchanged in any passage within
k edits. An Aho-Corasick automaton finds all pieces of all items in one pass over a text, and Myers' bit-parallel
distance, one machine-independent integer per item, decides each window that a piece points at. An item of fewer than
``WHOLE`` characters is found only as it stands, as whole words.

Documents are streamed where they lie: nothing of them is shuffled. Items travel to the tasks in groups of at most
about ``GROUP_CHARS`` characters, one pass over the documents a group, so what is sent stays bounded however long
the benchmark is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.llm.common import text_of

RATE, WHOLE, GROUP_CHARS = 0.08, 24, 4_000_000
_GAP, _WORD = re.compile(r"[\W_]+"), re.compile(r"[^\W_]+")
SCHEMA = "doc_id long, item_id long, distance int, start long, length long"


def normal(text: str) -> str:
    return _GAP.sub(" ", text).strip().lower()


def myers(pattern_bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any substring of ``text``, and the end of the first such substring."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    get = pattern_bits.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus = (down | ~(h | up)) & full
        minus = up & h
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
            if score < best:
                best, end = score, j + 1
        plus <<= 1
        minus <<= 1
        up = (minus | ~(x | plus)) & full
        down = plus & x & full
    return best, end


def bits_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Items:
    """A group of benchmark items, ready to search: built once a worker."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            m = len(text)
            k = int(rate * m) if m >= WHOLE else 0
            self.items.append((item_id, text, k, bits_of(text), bits_of(text[::-1])))
            cuts = [m * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((len(self.items) - 1, b))
        self.search = ahocorasick.Automaton()
        for p, at in pieces.items():
            self.search.add_word(p, at)
        if pieces:
            self.search.make_automaton()

    def found(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, length in ``text``) of each item's best passage, the first of equal ones."""
        words = normal(text)
        if not self.items or not words:
            return []
        done: set[tuple[int, int]] = set()
        best: dict[int, tuple[int, int, int]] = {}
        for last, at in self.search.iter(words):
            for i, b in at:
                _, item, k, bits, back = self.items[i]
                if len(item) < WHOLE:
                    s, e = last + 1 - len(item), last + 1
                    if i not in best and (s == 0 or words[s - 1] == " ") and (e == len(words) or words[e] == " "):
                        best[i] = (0, s, e)
                    continue
                diagonal = last + 1 - b
                band = diagonal // (k + 1)
                if (i, band) in done:
                    continue
                done.add((i, band))
                lo = max(0, band * (k + 1) - k)
                window = words[lo : (band + 1) * (k + 1) + len(item) + k]
                exact = window.find(item)
                if exact >= 0:
                    d, s, e = 0, lo + exact, lo + exact + len(item)
                else:
                    d, end = myers(bits, len(item), window)
                    if d > k:
                        continue
                    _, size = myers(back, len(item), window[:end][::-1][: len(item) + k])
                    s, e = lo + end - size, lo + end
                if i not in best or (d, s) < best[i][:2]:
                    best[i] = (d, s, e)
        if not best:
            return []
        spots, at = [], 0  # where each word stands in either text
        for m in _WORD.finditer(text):
            n = len(m[0].lower())
            spots.append((at, at + n, m.start(), m.end()))
            at += n + 1
        out = []
        for i, (d, s, e) in best.items():
            inside = [x for x in spots if x[0] < e and x[1] > s]
            out.append((self.items[i][0], d, inside[0][2], inside[-1][3] - inside[0][2]))
        return sorted(out)


def _groups(benchmark: DataFrame) -> Iterator:
    """Broadcast groups of (item_id, normalised text), each of a bounded size."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    n = 1 + int(items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // GROUP_CHARS
    for g in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == g).distinct().collect()
        yield benchmark.sparkSession.sparkContext.broadcast(sorted((r.item_id, t) for r in part if (t := normal(r.text))))


def matches(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE) -> DataFrame:
    """One row per document and item within ``rate`` edits a character: doc_id, item_id, distance, start, length.

    start and length give the best passage in the text, of equal ones the first, widened to whole words; an item that
    stands twice is one row, and items that match the same passage have a row each. Items of fewer than ``WHOLE``
    characters once normalised match only whole words equal to them; items without any letter or digit, null ones
    included, match nothing. Texts are searched whole, whatever their length; null and empty ones match nothing; rows
    with null or repeated doc_ids are searched as rows of their own; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    out = None
    for sent in _groups(benchmark):

        def run(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            search = Items(sent.value, rate)
            for f in frames:
                found = [(d, *x) for d, t in zip(f["doc_id"], f["text"], strict=True) for x in search.found(t)]
                got = pd.DataFrame(found, columns=["doc_id", "item_id", "distance", "start", "length"])
                yield got.astype({"doc_id": "Int64"})

        one = rows.mapInPandas(run, SCHEMA)
        out = one if out is None else out.union(one)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` whose text holds no item's passage, all columns kept; texts don't move."""
    out = docs
    for sent in _groups(benchmark):

        def leaks(parts: Iterator[pd.Series], sent=sent) -> Iterator[pd.Series]:
            search = Items(sent.value, rate)
            for texts in parts:
                yield pd.Series([bool(search.found(t)) for t in texts], dtype=bool)

        out = out.where(~F.pandas_udf(leaks, "boolean", F.PandasUDFType.SCALAR_ITER)(text_of()))
    return out
