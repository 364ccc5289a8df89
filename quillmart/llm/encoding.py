"""Whole texts to token ids with the tokenizers library, one library call per distinct word of a worker.

Both vocabularies split a text at white space before they merge, so the ids of a text are those of its chunks in
order. Chunks are cut only where the library always cuts, are dictionary-encoded by Arrow, and each distinct one
is encoded once and remembered, a word apart from the punctuation after it. The memory holds about ``LIMIT`` bytes a worker:
when half of it is full, what came before goes and what is in it stays for those who ask again. Texts are
taken ``PART`` characters at a time, so the working set doesn't grow with a batch, only with its longest text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LIMIT, PART = 48 << 20, 2_000_000
#: Of a remembered chunk besides its characters and ids: two objects and their place in the memory.
_OVERHEAD = 180
#: A byte-level vocabulary writes each byte as one printable character: printable Latin-1 bytes stand for
#: themselves, the others, in order, for the characters from U+0100 on.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_SPACE = chr(_BYTES[0x20])
_TAIL = ".,!?;:&*#$%"
#: A word of Latin letters, whose ids are those of its merges; from a chunk, all but the punctuation after it.
_LETTERS = "^[A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]+$"
_WORD = re.compile(_LETTERS.replace("$", r"\Z")).match
_HEAD = rf"^.*[^{re.escape(_TAIL)}]"


def gathered(pool: np.ndarray, first: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``pool[first[i] : first[i] + size[i]]`` for each i of ``at`` one after the other, and, from 0, where each ends."""
    sizes = size[at]
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    place = np.repeat((first[at] - upto[:-1]).astype(np.int32), sizes)
    place += np.arange(upto[-1], dtype=np.int32)
    return pool[place], upto


def _listed(values: pa.Array) -> list[str]:
    """The values, which hold no space, in one conversion."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pc.binary_join(whole, pa.scalar(" ", values.type))[0].as_py().split(" ")


class _Memory:
    """Ids of chunks: ``number`` of a chunk is its place in ``first`` and ``size``, which say where its ids lie in ``pool``."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.first, self.size, self.pool = np.zeros(1 << 10, np.int32), np.zeros(1 << 10, np.int32), np.zeros(1 << 12, np.uint32)
        self.n = self.used = self.weight = 0

    def add(self, keys: list[str], ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of new keys, which have ``size`` ids each of ``ids``."""
        n, used = self.n + len(keys), self.used + len(ids)
        for name, need in (("first", n), ("size", n), ("pool", used)):
            if len(old := getattr(self, name)) < need:
                setattr(self, name, np.concatenate([old, np.zeros(max(need - len(old), len(old) // 2), old.dtype)]))
        self.size[self.n : n] = size
        self.first[self.n : n] = self.used + np.cumsum(size) - size
        self.pool[self.used : used] = ids
        new = np.arange(self.n, n)
        self.number.update(zip(keys, range(self.n, n), strict=True))
        self.weight += sum(map(len, keys)) + 4 * len(ids) + _OVERHEAD * len(keys)
        self.n, self.used = n, used
        return new

    def find(self, keys: list[str]) -> np.ndarray:
        """Their numbers, -1 where a key isn't known."""
        return np.fromiter(map(self.number.get, keys, repeat(-1)), np.int64, len(keys))

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these chunks one after the other, and, from 0, where each chunk's end."""
        return gathered(self.pool, self.first, self.size, numbers)


class Chunks:
    """``encode(texts)`` yields, for successive parts of a list of texts, all ids and each text's first and last place."""

    def __init__(self, path: str, spaces: bool):
        """spaces: white space belongs to the ids (byte-level vocabulary); else it only separates words."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.spaces = Tokenizer.from_file(path), spaces
        # words of letters only need no more than the merges: many go in one text, cut at spaces
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next" if spaces else "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.library.get_vocab()
        #: Of each id, whether a word starts with it (byte-level) or ends with it.
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith(_SPACE) if spaces else t.endswith("</w>"))]] = True
        self.memory, self.old = _Memory(), _Memory()
        self.tails: dict[str, bytes] = {}

    @property
    def known(self) -> dict[str, int]:
        return self.memory.number

    @property
    def weight(self) -> int:
        return self.memory.weight + self.old.weight

    def _model(self, piece: str, lead: str = "") -> bytes:
        if not piece.isascii() or piece == "\n":
            piece = piece.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.library.model.tokenize(lead + piece)]).tobytes()

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            self.tails[tail] = self._model(tail) if tail else b""
        return self.tails[tail]

    def _add(self, keys: list[str], ids: list[bytes]) -> None:
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.memory.add(keys, np.frombuffer(b"".join(ids), "<u4"), size)

    def _add_words(self, words: list[str]) -> None:
        """Words of letters, after a space each if spaces have ids."""
        if not words:
            return
        texts = [" " * self.spaces + " ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.words.encode_batch_fast(texts, add_special_tokens=False)])
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) == len(words):
            self.memory.add(words, ids, np.diff(np.append(edges, len(ids))) if self.spaces else np.diff(edges, prepend=-1))
        else:
            self._add(words, [self._model(x, _SPACE * self.spaces) for x in words])

    def _recalled(self, keys: list[str]) -> list[str]:
        """Those keys that the older memory hasn't; what it has goes into the present one."""
        if not self.old.number:
            return keys
        numbers = self.old.find(keys)
        if len(have := np.flatnonzero(numbers >= 0)):
            ids, upto = self.old.ids(numbers[have])
            self.memory.add([keys[i] for i in have], ids, np.diff(upto))
        return [keys[i] for i in np.flatnonzero(numbers < 0)]

    def _learn(self, keys: list[str]) -> None:
        """A key is a word of Latin letters or another chunk; with white space, one after a space, unless a line break or NUL opens it."""
        slow, words, opening = [], [], []
        for k in self._recalled(keys):
            if _WORD(k):
                words.append(k)
                continue
            first = k[:1] if self.spaces and k[:1] in ("\n", "\0") else ""
            chunk = k[len(first) :]
            core = chunk.rstrip(_TAIL)
            if first and _WORD(core):
                opening.append((k, self._tail("\n" * (first == "\n")) + self._model(core) + self._tail(chunk[len(core) :])))
            else:
                slow.append((k, k if first == "\n" else " " * (self.spaces and not first) + chunk))
        self._add_words(words)
        if opening:
            self._add([k for k, _ in opening], [x for _, x in opening])
        if slow:
            self._add([k for k, _ in slow], [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast([x for _, x in slow], add_special_tokens=False)])

    def _numbers(self, keys: list[str]) -> np.ndarray:
        numbers = self.memory.find(keys)
        if len(missing := np.flatnonzero(numbers < 0)):
            unknown = [keys[i] for i in missing]
            self._learn(unknown)
            numbers[missing] = self.memory.find(unknown)
        return numbers

    def _of(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct chunks one after the other, and where each chunk's end: a word's, then those of the punctuation after it."""
        core = pc.utf8_rtrim(values, _TAIL)
        plain = pc.match_substring_regex(core, _LETTERS)
        word = core if self.spaces else pc.utf8_lower(core)
        coded = pc.if_else(plain, word, values).dictionary_encode()
        numbers = self._numbers(_listed(coded.dictionary))[np.asarray(coded.indices)]
        ends = pc.if_else(plain, pc.replace_substring_regex(values, _HEAD, ""), "").dictionary_encode()
        marks = ends.dictionary.to_pylist()
        new = [" " + t for t in marks if " " + t not in self.known]
        self._add(new, [self._tail(t[1:]) for t in new])
        after = self.memory.find([" " + t for t in marks])[np.asarray(ends.indices)]
        ids, upto = self.memory.ids(np.stack([numbers, after], 1).ravel())
        return ids, upto[::2]

    def _part(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd: dict[int, list[int]] = {}
        if self.spaces:  # runs of white space, and the mark itself, go to the library with their text
            odd = {i: self.library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if "\0" in t or re.search(r"\s\s", t)}
            texts = ["" if i in odd else "\0" + t.replace("\n", " \n") for i, t in enumerate(texts)]
        else:
            texts = [t.replace("\n", " ") for t in texts]
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends = np.asarray(cut.offsets, dtype=np.int64)
        coded = cut.values.dictionary_encode()
        if self.memory.weight > LIMIT // 2:
            self.old, self.memory = self.memory, _Memory()
        pool, first = self._of(coded.dictionary)
        at = np.asarray(coded.indices)
        ids, upto = gathered(pool, first[:-1], np.diff(first), at)
        bounds = upto[ends]
        if odd:
            each = [np.array(odd[i], "<u4") if i in odd else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            ids, bounds = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids, bounds

    def encode(self, texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yields (number of the first text, ids, bounds): text ``first + i`` has ``ids[bounds[i]:bounds[i + 1]]``."""
        part, n, first = [], 0, 0
        for t in texts:
            part.append(t)
            n += len(t)
            if n >= PART:
                yield first, *self._part(part)
                part, n, first = [], 0, first + len(part)
        if part:
            yield first, *self._part(part)

    def each(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        for _, ids, bounds in self.encode(texts):
            for i in range(len(bounds) - 1):
                yield ids[bounds[i] : bounds[i + 1]]


_made: dict[tuple, Chunks] = {}


def chunks(path: str, spaces: bool) -> Chunks:
    """One per worker process and vocabulary."""
    if (path, spaces) not in _made:
        _made[path, spaces] = Chunks(path, spaces)
    return _made[path, spaces]
