"""Cost-balanced packing of documents into training sequences.

A sequence's cost is ``linear * tokens + quadratic * sum(piece length squared)``, the work of a model whose
attention stays inside each document. Whole multiples of the capacity become full sequences of their own; what
remains of each document is assigned, longest first, to the sequence of lowest cost with room for it. A remainder
for which no sequence has room is cut and fills the sequences of lowest cost in turn, so all sequences of a block
are full but one.

Documents are taken in blocks of at most ``block_tokens`` tokens as each task streams its input: nothing is
shuffled or gathered, memory is bounded by a block, and a lost task is redone alone. At most one sequence a block
is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillmart.llm.common import given_back, text_of
from quillmart.llm.encoding import chunks

CAPACITY, BLOCK_TOKENS = 1024, 4_000_000
#: Pieces that go back to Spark at once.
ROWS = 2_048


def assign(lengths: list[int], capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY) -> list[list[tuple[int, int]]]:
    """Place pieces of at most ``capacity`` tokens; returns, for each piece, its parts as (sequence, length) in order.

    The fewest sequences that hold all tokens are opened. Ties go to the longer piece's earlier place, then the
    lower sequence number.
    """
    total = sum(lengths)
    n = -(-total // capacity)
    room = np.full(n, capacity, np.int64)
    cost = np.zeros(n)
    out: list[list[tuple[int, int]]] = [[] for _ in lengths]
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        left = lengths[i]
        while left:
            fits = np.where(room >= left, cost, np.inf)
            k = int(fits.argmin())
            if fits[k] == np.inf:
                k = int(np.where(room > 0, cost, np.inf).argmin())
            take = min(left, int(room[k]))
            out[i].append((k, take))
            room[k] -= take
            cost[k] += linear * take + quadratic * take * take
            left -= take
    return out


def _blocks(batches: Iterator[pa.RecordBatch], path: str, end_id: int, block_tokens: int) -> Iterator[list[tuple[object, np.ndarray]]]:
    block, n = [], 0
    coder = chunks(path, spaces=True)
    end = np.array([end_id], "<u4")
    for b in batches:
        # texts leave the batch as they are encoded, so there is no second copy of it
        for doc_id, ids in zip(b.column("doc_id"), coder.each(x.as_py() for x in b.column("text")), strict=True):
            block.append((doc_id.as_py(), np.concatenate([ids, end])))
            n += len(ids) + 1
            if n >= block_tokens:
                yield block
                block, n = [], 0
                given_back()
    if block:
        yield block


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 0, block_tokens: int = BLOCK_TOKENS, with_ids: bool = True) -> DataFrame:
    """Pack every document of ``docs(doc_id, text)``; one row per piece.

    Returns doc_id, start (ids of the document before the piece), length, ids_crc32, doc_tokens (the end id
    included), sequence_id, offset, and with ``with_ids`` the piece's ids. A null text is empty and is packed as
    its end id alone; null and repeated doc_ids are packed as rows of their own; other columns are ignored; an
    empty table gives no rows. ``tokenizer`` is a byte-level vocabulary file of the tokenizers library, present on
    every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given_back()  # the worker may have served another stage
        sequence = TaskContext.get().partitionId() << 40
        for block in _blocks(batches, tokenizer, end_id, block_tokens):
            rows = []
            tails = []
            for k, (_, ids) in enumerate(block):
                whole = len(ids) // capacity * capacity
                for s in range(0, whole, capacity):
                    rows.append((s, capacity, k, sequence, 0))
                    sequence += 1
                if whole < len(ids):
                    tails.append((k, whole))
            used: dict[int, int] = {}
            for (k, start), parts in zip(tails, assign([len(block[k][1]) - s for k, s in tails], capacity), strict=True):
                for q, take in parts:
                    rows.append((start, take, k, sequence + q, used.get(q, 0)))
                    used[q] = used.get(q, 0) + take
                    start += take
            sequence += len(used)
            for at in range(0, len(rows), ROWS):
                start, length, which, sequences, offset = np.array(rows[at : at + ROWS], np.int64).T
                pieces = [block[k][1][s : s + n] for s, n, k in zip(start, length, which, strict=True)]
                columns = [
                    pa.array([block[k][0] for k in which], pa.int64()), pa.array(start), pa.array(length), pa.array(sequences), pa.array(offset),
                    pa.array([zlib.crc32(p) for p in pieces], pa.int64()), pa.array([len(block[k][1]) for k in which], pa.int64()),
                ]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pieces).view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "sequence_id", "offset", "ids_crc32", "doc_tokens", "ids"][: len(columns)])
            del block

    schema = "doc_id long, start long, length long, sequence_id long, offset long, ids_crc32 long, doc_tokens long"
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, schema + ", ids array<int>" * with_ids)
