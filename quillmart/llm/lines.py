"""Fuzzy line deduplication by MinHash.

Lines are compared in lower case with white space collapsed; blank lines are layout and always stay. A line's
shingles are the ``SPAN`` characters from each of its characters on. Bands of several minima are made of them (see
``Bands``: wider for more lines, and more of them, so that a band holds few lines that only share common shingles and
recall stays the same at every size); lines that share a band are candidates, two lines are linked if the Jaccard similarity of their whole shingle
sets, computed from the texts, is ``SIMILARITY`` or more, and one line of each component of links stays: the first by
doc_id and place.

Equal lines are merged before bands are compared, so however common a line is it enters once. A band is streamed in
sorted order: each line is compared with the band's least one and with the one before it, which settles bands of up
to three lines. A larger band whose lines still are in several components goes on: of up to ``SMALL`` lines all pairs
across components are compared; up to ``GROUP`` lines are compared in one task as a product of incidence matrices,
which returns links, never pairs; more are banded anew by other minima, which tells apart what only seemed alike, and
after ``LEVELS`` such rounds dealt out as pairs of parts. So rows stay in proportion to lines, and no pair of a band is
left out unless it is connected already.

Before texts are fetched, ``SKETCH`` one-bit minima must agree in at least ``AGREE``: 28.8 of 32 do at a similarity of
0.8, 16 by chance.

Signatures, sketches and comparisons are NumPy in Arrow batches; see the README for why they aren't native.
Whole documents move twice, to meet the places of candidate lines and of lines that go.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.llm.common import components, free_name, stored, told_apart

SPAN, SIMILARITY = 5, 0.8
#: The similarity of lines that have only common shingles in common, and the share of links that bands may miss at the threshold.
BACKGROUND, MISSED = 0.02, 0.01
SKETCH, AGREE = 32, 23
SMALL, GROUP, LEVELS, CHARS, BATCH, STEP = 16, 2048, 6, 4_000_000, 1_000_000, 1 << 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BAND = "band long, h1 long, note long"


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(h, start): a 64-bit hash of every shingle, repeats included; line i has those from start[i] on.

    A line shorter than ``SPAN`` is its own only shingle.
    """
    lines = [x.ljust(SPAN, "\0") for x in lines]
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(codes) - SPAN + 1
    h = codes[:n] * _A
    for k in range(1, SPAN):
        h ^= h >> np.uint64(29)
        h += codes[k : k + n]
        h *= _B
    h ^= h >> np.uint64(32)
    ends, count = np.cumsum(size), size - SPAN + 1
    inside = np.ones(len(codes), bool)
    for k in range(1, SPAN):
        inside[ends - k] = False
    return h[inside[:n]], np.cumsum(count) - count


def distinct(lines: list[str]) -> list[np.ndarray]:
    """The sorted distinct hashes of each line's shingles."""
    if not lines:
        return []
    h, start = hashes(lines)
    return [np.unique(x) for x in np.split(h, start[1:])]


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= similarity * (len(x) + len(y) - common)


@dataclass(frozen=True)
class Bands:
    """``bands`` bands of ``rows`` minima each."""

    bands: int
    rows: int

    @classmethod
    def of(cls, lines: int, similarity: float) -> Bands:
        """Rows so that one line in 20 shares a band with another of ``BACKGROUND`` similarity, bands so that at most ``MISSED`` links are missed."""
        rows = max(3, math.ceil(math.log(20 * max(lines, 1)) / -math.log(BACKGROUND)))
        return cls(math.ceil(math.log(MISSED) / math.log(1 - min(similarity, 0.99) ** rows)), rows)


def signed(lines: list[str], scheme: Bands, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(bands, note) of normalised lines: 64-bit band keys, and the length in the upper and the sketch in the lower half."""
    rows, bands = scheme.rows, scheme.bands
    total = max(rows * bands, SKETCH)
    seeds = np.random.default_rng(1 + level).integers(0, 1 << 31, total, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    parts, part, chars = [], [], 0
    for i, x in enumerate(lines):
        part.append(x)
        chars += len(x)
        if chars >= STEP or i == len(lines) - 1:
            h, start = hashes(part)
            h = h.astype(np.uint32)
            parts.append(np.stack([np.minimum.reduceat(h * m, start) for m in seeds], 1))
            part, chars = [], 0
    least = np.concatenate(parts) if parts else np.zeros((0, total), np.uint32)
    keys = np.empty((len(lines), bands), np.uint64)
    for b in range(bands):
        k = np.full(len(lines), 1 + b + bands * level, np.uint64)
        for r in range(rows):
            k = (k ^ least[:, b * rows + r]) * _B
            k ^= k >> np.uint64(31)
        keys[:, b] = k
    spread = np.arange(SKETCH) * total // SKETCH
    bits = np.packbits((least[:, spread] >> np.uint32(16)).astype(np.uint8) & 1, axis=1)
    note = np.fromiter(map(len, lines), np.int64, len(lines)) << 32 | np.ascontiguousarray(bits).view(np.uint32)[:, 0].astype(np.int64)
    return keys.view(np.int64), note


def _lines(table: DataFrame, scheme: Bands) -> DataFrame:
    """_doc, _pos, h1, h2 of every line that isn't blank; its bands and note where it is the first such line of a batch."""
    kind = table.schema["_doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, known, rows, chars = b.column("_text"), {}, [], 0
            for i in range(len(texts)):
                for p, x in enumerate(texts[i].as_py().split("\n")):
                    if x := normal(x):
                        chars += 0 if x in known else len(x)
                        rows.append((i, p, known.setdefault(x, len(known))))
                if rows and (chars >= BATCH or i == len(texts) - 1):
                    yield _batch(b.column("_doc"), list(known), np.array(rows, np.int64), scheme)
                    known, rows, chars = {}, [], 0
            if rows:
                yield _batch(b.column("_doc"), list(known), np.array(rows, np.int64), scheme)

    return table.select("_doc", "_text").mapInArrow(run, f"_doc {kind}, _pos int, h1 long, h2 long, bands array<long>, note long")


def _batch(docs: pa.Array, lines: list[str], rows: np.ndarray, scheme: Bands) -> pa.RecordBatch:
    """rows: (place of the document, of the line in it, number of the line among ``lines``)."""
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines), "<i8").reshape(-1, 2)
    bands, note = signed(lines, scheme)
    which = rows[:, 2]
    first = np.zeros(len(rows), bool)
    first[np.unique(which, return_index=True)[1]] = True
    ends = np.concatenate([[0], np.cumsum(first)]).astype(np.int32) * scheme.bands
    at = which[first]
    columns = [
        docs.take(pa.array(rows[:, 0])), pa.array(rows[:, 1].astype(np.int32)), pa.array(digests[which, 0]), pa.array(digests[which, 1]),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[at].ravel())), pa.array(note[which]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["_doc", "_pos", "h1", "h2", "bands", "note"])


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the sketches of two arrays of notes agree."""
    return np.bitwise_count((x ^ y) & np.int64(0xFFFFFFFF)) <= SKETCH - AGREE


def _grouped(banded: DataFrame) -> DataFrame:
    """Every row of a band that several lines have, with its place there, the band's least line and the line before it.

    ``near`` and ``near_last`` say whether the sketches allow a link with these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # band, h1, note of the latest row, its place and the least line of its band
        for b in batches:
            band, h1, note = (b.column(c).to_numpy() for c in ("band", "h1", "note"))
            if head is not None:
                band, h1, note = (np.concatenate([[x], y]) for x, y in zip(head[:3], (band, h1, note), strict=True))
            fresh = np.concatenate([[True], (band[1:] != band[:-1]) | (h1[1:] != h1[:-1])])
            band, h1, note = band[fresh], h1[fresh], note[fresh]
            if not len(band):
                continue
            new = np.concatenate([[True], band[1:] != band[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(band)), 0))
            place, least, least_note = np.arange(len(band)) - first, h1[first], note[first]
            if head is not None:
                running = first == 0
                place[running] += head[3]
                least[running], least_note[running] = head[4:]
            before = np.concatenate([[0], np.arange(len(band) - 1)])
            out = place > 0
            out[0] &= head is None
            out[:-1] |= (place[:-1] == 0) & (place[1:] == 1)
            near, near_last = _alike(note, least_note), _alike(note, note[before])
            columns = (band, h1, note, place, least, h1[before], near, near_last)
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in columns], ["band", "h1", "note", "place", "least", "last", "near", "near_last"])
            head = (band[-1], h1[-1], note[-1], place[-1], least[-1], least_note[-1])

    rows = banded.repartition("band").sortWithinPartitions("band", "h1")
    return stored(rows.mapInArrow(run, _BAND + ", place long, least long, last long, near boolean, near_last boolean"), "bands")


def _pairs(grouped: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) that the comparisons within the bands ask for."""
    x = grouped.where("place > 0 and near").select(F.col("h1").alias("a"), F.col("least").alias("b"))
    y = grouped.where("place > 1 and near_last").select(F.col("h1").alias("a"), F.col("last").alias("b"))
    return x.union(y).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _texts(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """h1, norm of the wanted (h1, first): the documents move to them."""
    by_doc = wanted.groupBy(F.col("first._doc").alias("_doc")).agg(F.collect_list(F.struct(F.col("first._pos").alias("p"), "h1")).alias("at"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = []
            for text, at in f.itertuples(index=False):
                lines = text.split("\n")
                for p, h in ((x["p"], x["h1"]) for x in at):
                    if p < len(lines) and xxhash.xxh3_128_digest(x := normal(lines[p]).encode("utf-8", "surrogatepass"))[:8] == int(h).to_bytes(8, "little", signed=True):
                        got.append((h, x.decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(got, columns=["h1", "norm"]).astype({"h1": "int64"})

    found = table.select("_doc", "_text").join(by_doc, "_doc").select("_text", "at").mapInPandas(run, "h1 long, norm string")
    return stored(found.dropDuplicates(["h1"]), "texts")


def _verified(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct pairs (a, b) of h1 whose whole shingle sets are similar."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[str, np.ndarray] = {}
        for f in frames:
            for s in range(0, len(f), 512):
                part = f.iloc[s : s + 512]
                if len(sets) > 2_000:
                    sets.clear()
                x, y = part["x"].tolist(), part["y"].tolist()
                fresh = [t for t in dict.fromkeys(x + y) if t not in sets]
                sets.update(zip(fresh, distinct(fresh), strict=True))
                yield part.loc[[similar(sets[u], sets[v], similarity) for u, v in zip(x, y, strict=True)], ["a", "b"]]

    x, y = (texts.select(F.col("h1").alias(k), F.col("norm").alias(t)) for k, t in (("a", "x"), ("b", "y")))
    return stored(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long"), "similar")


def _groups(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(frame, first, size): frames sorted by band that end with a band, where each band of them starts, and its rows."""
    rest = None
    for f in frames:
        f = f if rest is None else pd.concat([rest, f], ignore_index=True)
        band = f["band"].to_numpy()
        cuts = np.concatenate([[0] * bool(len(f)), np.flatnonzero(band[1:] != band[:-1]) + 1]).astype(np.int64)
        if len(cuts) > 1:
            yield f.iloc[: cuts[-1]], cuts[:-1], np.diff(cuts)
        rest = f.iloc[cuts[-1] :] if len(cuts) else f
    if rest is not None and len(rest):
        yield rest, np.array([0]), np.array([len(rest)])


def common_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(inter, size): how many shingles each two of the lines share, and how many each has.

    Shingles of few lines are counted by their pairs, the others as products of incidence matrices, block by block.
    """
    n = len(lines)
    h, start = hashes(lines)
    which = np.repeat(np.arange(n), np.diff(np.append(start, len(h))))
    order = np.lexsort((which, h))
    h, which = h[order], which[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (which[1:] != which[:-1])])
    h, which = h[fresh], which[fresh]
    size = np.bincount(which, minlength=n)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    often = np.diff(np.append(first, len(h)))
    inter = np.zeros((n, n), np.int64)
    for d in np.unique(often[(often > 1) & (often <= 8)]):
        at = which[first[often == d][:, None] + np.arange(d)]
        u, v = np.triu_indices(d, 1)
        inter += np.bincount((at[:, u] * n + at[:, v]).ravel(), minlength=n * n).reshape(n, n)
    inter += inter.T
    many = np.flatnonzero(often > 8)
    for s in range(0, len(many), 2048):
        part = many[s : s + 2048]
        rows = np.concatenate([which[first[k] : first[k] + often[k]] for k in part])
        x = np.zeros((n, len(part)), np.float32)
        x[rows, np.repeat(np.arange(len(part)), often[part])] = 1
        inter += (x @ x.T).astype(np.int64)
    return inter, size


def across(lines: list[str], apart: list[int], similarity: float) -> list[tuple[int, int]]:
    """Links of lines of different components, as places (i, j): enough to connect all that are similar."""
    n, root = len(lines), {c: c for c in apart}

    def top(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    if sum(map(len, lines)) <= CHARS:
        inter, size = common_shingles(lines)
        found = zip(*np.nonzero(np.triu(inter >= similarity * (size[:, None] + size - inter), 1)), strict=True)
    else:  # few very long lines: one set beside the sorted hashes of each
        each = distinct(lines)
        found = ((i, j) for i in range(n) for j in range(i + 1, n) if top(apart[i]) != top(apart[j]) and similar(each[i], each[j], similarity))
    links = []
    for i, j in found:
        if (x := top(apart[i])) != (y := top(apart[j])):
            root[max(x, y)] = min(x, y)
            links.append((int(i), int(j)))
    return links


def _small(member: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) across the components c of each group of ``member(band, h1, note, c)``, as sketches allow."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, first, size in _groups(frames):
            h, note, c = (f[x].to_numpy() for x in ("h1", "note", "c"))
            for n in np.unique(size):
                u, v = np.triu_indices(n, 1)
                i, j = ((first[size == n][:, None] + x).ravel() for x in (u, v))
                ask = _alike(note[i], note[j]) & (c[i] != c[j])
                yield pd.DataFrame({"a": np.maximum(h[i[ask]], h[j[ask]]), "b": np.minimum(h[i[ask]], h[j[ask]])})

    return member.repartition("band").sortWithinPartitions("band", "h1").mapInPandas(run, "a long, b long").distinct()


def _settled(member: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) across the components c of each group of ``member(band, h1, note, c)`` of at most ``GROUP`` rows."""

    def pruned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, first, size in _groups(frames):
            note, c, keep = f["note"].to_numpy(), f["c"].to_numpy(), np.zeros(len(f), bool)
            for at, n in zip(first, size, strict=True):
                x, k = note[at : at + n], c[at : at + n]
                keep[at : at + n] = (_alike(x[:, None], x) & (k[:, None] != k)).any(1)
            yield f[keep]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, first, size in _groups(frames):
            h, c, norm = f["h1"].to_numpy(), f["c"].tolist(), f["norm"].tolist()
            for at, n in zip(first, size, strict=True):
                if links := across(norm[at : at + n], c[at : at + n], similarity):
                    i, j = np.array(links).T + at
                    yield pd.DataFrame({"a": np.maximum(h[i], h[j]), "b": np.minimum(h[i], h[j])})

    rows = member.repartition("band").sortWithinPartitions("band", "h1").mapInPandas(pruned, _BAND + ", c long")
    rows = stored(rows, "crowds").join(texts, "h1").select("band", "h1", "c", "norm")
    return stored(rows.repartition("band").sortWithinPartitions("band", "h1").mapInPandas(run, "a long, b long").distinct(), "similar")


def _banded_anew(member: DataFrame, texts: DataFrame, scheme: Bands, level: int) -> DataFrame:
    """``member`` with its bands split by the bands of another level."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bands, note = signed(f["norm"].tolist(), scheme, level)
            yield pd.DataFrame({"h1": f["h1"], "anew": list(bands), "note": note})

    lines = texts.join(member.select("h1").distinct(), "h1").select("h1", "norm").mapInPandas(run, "h1 long, anew array<long>, note long")
    rows = member.select("band", "h1").join(stored(lines, "bands"), "h1").select("band", "h1", "note", F.explode("anew").alias("other"))
    return rows.select(F.xxhash64("band", "other").alias("band"), "h1", "note")


def _dealt(member: DataFrame) -> DataFrame:
    """Large groups as pairs of parts of half the group size, each pair a group of its own."""
    parts = F.ceil(F.col("n") / (GROUP // 2)).cast("int")
    rows = member.select("*", F.pmod(F.xxhash64("h1"), parts).cast("int").alias("part"), parts.alias("parts"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select(F.xxhash64("band", F.least("part", "other"), F.greatest("part", "other")).alias("band"), "h1", "note", "c")


def _links(table: DataFrame, lines: DataFrame, scheme: Bands, similarity: float) -> DataFrame:
    """Links (a, b) of the h1 of similar lines, enough to connect them."""
    banded = lines.where("size(bands) > 0").select(F.explode("bands").alias("band"), "h1", "note")
    first = lines.groupBy("h1").agg(F.min(F.struct("_doc", "_pos")).alias("first"))
    links, texts = None, None
    for level in range(LEVELS + 1):
        grouped = _grouped(banded)
        if texts is None:
            texts = _texts(table, first.join(grouped.select("h1").distinct(), "h1"))
        found = _verified(texts, _pairs(grouped), similarity)
        links = found if links is None else links.union(found)
        member = grouped.join(components(links).withColumnRenamed("node", "h1"), "h1", "left").select("band", "h1", "note", F.coalesce("component", "h1").alias("c"))
        size = member.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.shiftright("note", 32)).alias("chars"), F.min("c").alias("lo"), F.max("c").alias("hi"))
        member = stored(member.join(size.where("n > 3 and lo <> hi").select("band", "n", "chars"), "band"), "crowds")
        fits = (F.col("n") <= GROUP) & (F.col("chars") <= CHARS)
        rows = member.select("band", "h1", "note", "c", "n")
        links = links.union(_verified(texts, _small(rows.where(F.col("n") <= SMALL).drop("n")), similarity))
        links = links.union(_settled(rows.where((F.col("n") > SMALL) & fits).drop("n"), texts, similarity))
        large = rows.where((F.col("n") > SMALL) & ~fits)
        if large.isEmpty():
            return links
        if level == LEVELS:
            return links.union(_settled(_dealt(large), texts, similarity))
        banded = _banded_anew(large, texts, scheme, level + 1)


def _decided(table: DataFrame, similarity: float) -> DataFrame:
    """_doc, _pos of every line that goes."""
    count = table.agg(F.sum(F.length("_text") - F.length(F.replace("_text", F.lit("\n"))) + 1)).first()[0]
    scheme = Bands.of(count or 0, similarity)
    lines = stored(_lines(table, scheme), "lines")
    found = components(_links(table, lines, scheme, similarity)).withColumnRenamed("node", "h1")
    own = lines.groupBy("h1", "h2").agg(F.min(F.struct("_doc", "_pos")).alias("first"), F.count("*").alias("n"))
    linked = own.join(found, "h1")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    linked = linked.join(least, "component").select("h1", "h2", "n", "first", F.col("least").alias("keep"))
    alone = own.where("n > 1").join(found, "h1", "left_anti").select("h1", "h2", "n", "first", F.col("first").alias("keep"))
    # a line that stands once and is the one kept has nothing to decide
    kept = linked.union(alone).where("n > 1 or keep <> first").select("h1", "h2", "keep")
    every = lines.select("_doc", "_pos", "h1", "h2")
    return every.join(kept, ["h1", "h2"]).where((F.col("_doc") != F.col("keep._doc")) | (F.col("_pos") != F.col("keep._pos"))).select("_doc", "_pos")


def dedup(docs: DataFrame, similarity: float = SIMILARITY, lines: str = "_lines", removed: str = "_removed") -> DataFrame:
    """``docs`` without repeated lines: all columns kept, and the columns ``lines``, ``removed`` count each row's lines.

    The text keeps its remaining lines as they were, joined by line breaks. A null text stays null and an empty one
    empty; rows of a repeated doc_id are documents of their own, the later ones after the first, in the order in which
    they are read; rows with a null doc_id take no part and stay whole. Columns of ``docs`` may have any names, but those of the two counts are replaced by
    them. An empty table gives no rows.
    """
    named = docs.select(docs["doc_id"].alias("_doc"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"))
    text = F.coalesce(F.col("_row.text").cast("string"), F.lit(""))
    named, again = told_apart(named, "_doc", "_copy")
    if again:
        named = named.withColumn("_doc", F.when(F.col("_doc").isNotNull(), F.struct(F.col("_doc").alias("id"), F.col("_copy").alias("copy"))))
    table = named.where("_doc is not null")
    gone = stored(_decided(table.select("_doc", text.alias("_text")), similarity), "repeats").groupBy("_doc").agg(F.collect_set("_pos").alias("_gone"))
    rows = table.join(gone, "_doc", "left").select("_row", "_gone").unionByName(named.where("_doc is null").select("_row"), allowMissingColumns=True)
    split = F.split(text, "\n")
    kept = F.filter(split, lambda x, i: ~F.array_contains(F.col("_gone"), i))
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c.lower() not in (lines.lower(), removed.lower())]
    count = F.coalesce(F.size("_gone"), F.lit(0))
    return rows.select(*columns, F.size(split).cast("long").alias(lines), F.when(F.col("_gone").isNull(), 0).otherwise(count).cast("long").alias(removed))


def without_repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with its own columns, whatever their names; documents of which nothing but blank lines remains go."""
    lines, removed = free_name("_lines", docs.columns), free_name("_removed", docs.columns)
    out = dedup(docs, similarity, lines, removed)
    return out.where(~((F.col(removed) > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == ""))).select(*docs.columns)
