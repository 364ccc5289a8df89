"""Best-fit packing into as few sequences as possible, by exact complements.

Longer documents are cut into whole sequences; every remaining piece stays whole. Pieces are counted by length. From
the longest down, a piece opens a sequence, and what is missing is looked up among the sums of one, two and three
lengths: an index keeps, for every sum, a cursor over the combinations that make it, and passes those for which
pieces have run out. Pieces only ever leave, so a combination once passed never comes back and no cursor turns. Where
no three pieces fill the gap, the longest one that fits goes in and what is then missing is looked up again. What
finds no exact complement is packed by best fit, longest first, and so is the whole block once more for comparison:
the plan with fewer sequences counts.

Documents are taken in blocks of at most ``block_tokens`` tokens as each task streams its input: nothing is shuffled
or gathered, memory is bounded by a block, and a lost task is redone alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillmart.llm.common import text_of
from quillmart.llm.encoding import chunks

CAPACITY, BLOCK_TOKENS = 2048, 8_000_000


class Sums:
    """For every sum, the combinations of one, two and three lengths that make it, as far as pieces are there.

    ``count[n]`` pieces of length n are there; it may only fall. A cursor of a sum stands at the greatest length
    that may still lead a combination, and only moves down.
    """

    def __init__(self, count: list[int]):
        self.count = count
        self.two = list(range(len(count)))
        self.three = list(range(len(count)))

    def _pair(self, total: int, held: int = 0) -> tuple[int, int] | None:
        """The first pair that sums to ``total``, one piece of length ``held`` not counting."""
        count, a = self.count, min(self.two[total], total - 1)
        while 2 * a >= total and not (count[a] and count[total - a] > (2 * a == total)):
            a -= 1
        self.two[total] = a
        while 2 * a >= total:  # the cursor stays at what only the held piece may spoil
            b, twice = total - a, 2 * a == total
            if count[a] - (a == held) > twice and count[b] - (b == held) > twice:
                return a, b
            a -= 1
        return None

    def _triple(self, total: int) -> tuple[int, int, int] | None:
        a = min(self.three[total], total - 2)
        while 3 * a >= total:
            if self.count[a] and (pair := self._pair(total - a, held=a)) is not None:
                break
            a -= 1
        self.three[total] = a
        return (a, *pair) if 3 * a >= total else None

    def take(self, total: int) -> tuple[int, ...] | None:
        """A combination of at most three that sums to ``total``, taken out of the counts; longer pieces go first."""
        found = (total,) if self.count[total] else self._pair(total) or self._triple(total)
        for n in found or ():
            self.count[n] -= 1
        return found


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of the pieces, longest first, each to the fullest bin with room for it. Bins with equal room are one stack."""
    out: list[list[int]] = []
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin with room r exists
    for n in sorted(lengths, reverse=True):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            k = at[room].pop()
            if not at[room]:
                rooms ^= 1 << room
        else:
            room, k = capacity, len(out)
            out.append([])
        out[k].append(n)
        if left := room - n:
            at[left].append(k)
            rooms |= 1 << left
    return out


def exact_first(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins filled exactly where a complement exists, and best-fit ones of the rest."""
    count = [0] * (capacity + 1)
    for n in lengths:
        count[n] += 1
    index, out, rest = Sums(count), [], []
    longest = capacity
    while True:
        while longest and not count[longest]:
            longest -= 1
        if not longest:
            break
        count[longest] -= 1
        bin_, gap, reach = [longest], capacity - longest, longest
        while gap:
            if (found := index.take(gap)) is not None:
                bin_ += found
                gap = 0
                break
            while reach and not (reach <= gap and count[reach]):
                reach -= 1
            if not reach:
                break
            count[reach] -= 1
            bin_.append(reach)
            gap -= reach
        if gap:
            rest += bin_
        else:
            out.append(bin_)
    return out + best_fit(rest, capacity)


def planned(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of lengths of at most ``capacity``, each piece in one of them."""
    exact, plain = exact_first(lengths, capacity), best_fit(lengths, capacity)
    return exact if len(exact) <= len(plain) else plain


def _placed(sizes: list[int], capacity: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document, piece, start, length, sequence, offset) of a block of documents of these sizes."""
    tails: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for k, n in enumerate(sizes):
        whole = n // capacity
        for p in range(whole):
            yield k, p, p * capacity, capacity, sequence, 0
            sequence += 1
        if n % capacity:
            tails.setdefault(n % capacity, []).append((k, whole, whole * capacity))
    for stack in tails.values():
        stack.reverse()  # of pieces of one length, earlier documents are placed first
    for bin_ in planned([n for n, stack in tails.items() for _ in stack], capacity):
        offset = 0
        for n in bin_:
            yield *tails[n].pop(), n, sequence, offset
            offset += n
        sequence += 1


def _blocks(frames: Iterator[pd.DataFrame], path: str, end_id: int, block_tokens: int) -> Iterator[list[tuple[object, np.ndarray]]]:
    block, n = [], 0
    coder = chunks(path, spaces=False)
    end = np.array([end_id], "<u4")
    for f in frames:
        for doc_id, ids in zip(f["doc_id"], coder.each(f["text"].tolist()), strict=True):
            block.append((doc_id, np.concatenate([ids, end])))
            n += len(ids) + 1
            if n >= block_tokens:
                yield block
                block, n = [], 0
    if block:
        yield block


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 0, block_tokens: int = BLOCK_TOKENS, with_ids: bool = True) -> DataFrame:
    """Pack every document of ``docs(doc_id, text)``; one row per piece.

    Returns doc_id, piece (from 0), start (ids of the document before the piece), length, ids_crc32, sequence_id,
    offset, and with ``with_ids`` the piece's ids. Only documents of more than ``capacity`` ids, ``end_id`` included,
    are cut, into pieces of ``capacity``, the last shorter. A null text is empty and is packed as its end id alone;
    null and repeated doc_ids are packed as rows of their own; other columns are ignored; an empty table gives no
    rows. ``tokenizer`` is a vocabulary file with word ends of the tokenizers library, present on every executor.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 40
        for block in _blocks(frames, tokenizer, end_id, block_tokens):
            rows = list(_placed([len(ids) for _, ids in block], capacity))
            for at in range(0, len(rows), 20_000):
                part = rows[at : at + 20_000]
                f = pd.DataFrame([(block[k][0], p, s, n, first + q, o) for k, p, s, n, q, o in part], columns=["doc_id", "piece", "start", "length", "sequence_id", "offset"])
                pieces = [block[k][1][s : s + n] for k, _, s, n, _, _ in part]
                f["doc_id"], f["piece"] = f["doc_id"].astype("Int64"), f["piece"].astype(np.int32)
                f["ids_crc32"] = [zlib.crc32(x) for x in pieces]
                if with_ids:
                    f["ids"] = [x.astype(np.int32) for x in pieces]
                yield f
            first += 1 + max(r[4] for r in rows)

    schema = "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids_crc32 long"
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInPandas(run, schema + ", ids array<int>" * with_ids)
