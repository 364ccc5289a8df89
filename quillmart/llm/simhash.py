"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's bits stand in blocks; a block of ``width`` bits is cut into ``radius + 1`` segments on a ring. If two
blocks differ in at most ``radius`` bits, some segment starts a chain whose running differences stay within their
proportional share: none in the first segment, at most one in the first two, at most two in the first three, and so
on. So pairs are sought only among fingerprints equal in one segment and at most one bit apart in the next: each
fingerprint gives its exact key and, for every set bit of the second segment, the key with that bit cleared, and a
cleared key meets exact keys only. Later links of the chain and then the full Hamming distance decide.

Equal fingerprints are merged first, before any key is made. Keys that no second fingerprint shares are dropped
before fingerprints are brought in. Groups of one key are streamed in sorted order; a group of more than ``GROUP``
members is compared as pairs of parts of that size in different tasks. Of large groups only a spanning star of each
set of linked members is returned, so links stay in proportion to members; no partner is ever left out.

A scheme with a ``similarity`` takes fingerprints for candidates only: links are those whose whole shingle sets are
that similar, computed from the texts. Of large groups the stars are verified first, then all near pairs across what
is still apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.llm.common import components, stored, text_of

GROUP, SMALL = 1024, 16


@dataclass(frozen=True)
class Scheme:
    """How texts become fingerprints and which of them link.

    ``words`` a shingle; ``blocks`` of ``width`` bits; candidates agree within ``radius`` bits in some block; links
    differ in at most ``limit`` bits overall. With ``bits``, fingerprints have that many and the blocks are dealt from
    them again and again, in another order each time. With ``similarity``, links need that Jaccard similarity of the
    shingle sets too.
    """

    words: int = 3
    blocks: int = 1
    width: int = 64
    radius: int = 2
    limit: int = 2
    bits: int | None = None
    similarity: float | None = None

    @property
    def lanes(self) -> int:
        return (self.bits or self.blocks * self.width) // 64

    @property
    def places(self) -> np.ndarray:
        """The bits of each block."""
        bits, draw = 64 * self.lanes, np.random.default_rng(42)
        each = bits // self.width
        deals = [np.arange(bits)] + [draw.permutation(bits) for _ in range((self.blocks - 1) // each)]
        return np.concatenate([d[: each * self.width].reshape(each, self.width) for d in deals])[: self.blocks]

    @property
    def segments(self) -> list[tuple[int, int]]:
        m = self.radius + 1
        cuts = [self.width * i // m for i in range(m + 1)]
        return list(zip(cuts, cuts[1:], strict=False))


#: Within 2 of 64 bits, over 3-word shingles.
NARROW = Scheme()
#: Five-word shingles at a similarity of 0.8: the cosine of two sets is then 2 * 0.8 / 1.8 and 15.15 % of bits differ,
#: 58.2 with a standard deviation of 7; 80 is three of them more. Equal blocks of 24 bits, 240 times, find candidates.
WIDE = Scheme(words=5, blocks=240, width=24, radius=0, limit=80, bits=384, similarity=0.8)
#: Two members of a key group of whole blocks meet only if, of so many bits, no more than so many differ: 4.8 at 0.8, 16 by chance.
SKETCH, SKETCHED = 32, 12
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str, words: int) -> list[bytes]:
    """Space-joined shingles, repeats included, of the words between ASCII white space, A-Z in lower case."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return [b" ".join(x) for x in zip(*(w[i:] for i in range(words)), strict=False)]


def fingerprint(text: str, scheme: Scheme) -> np.ndarray:
    return sized(text, scheme)[0]


def hashes(text: str, words: int) -> np.ndarray:
    """XXH64 with seed 42 of each shingle, repeats included."""
    found = shingles(text, words)
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in found), np.uint64, len(found))


def sized(text: str, scheme: Scheme) -> tuple[np.ndarray, int]:
    """``lanes`` 64-bit words and a digest of the shingle set; bit b of lane 0 is 1 if it is set in over half the shingles' XXH64 with seed 42.

    Further lanes take the same from those hashes multiplied by odd constants and folded. No words: zero. With a
    similarity each shingle counts once, as in the sets, and a tied bit is that of the least hash.
    """
    h = hashes(text, scheme.words)
    if not len(h):
        return np.zeros(scheme.lanes, np.uint64), 0
    digest, tied = 0, 0
    if scheme.similarity:
        h = np.unique(h)
        digest = xxhash.xxh64_intdigest(h.tobytes())
    total = np.zeros(64 * scheme.lanes, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = [h[i : i + (1 << 14)]]
        for c in _MIX[: scheme.lanes - 1]:
            x = part[0] * c
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            part.append(x ^ (x >> np.uint64(29)))
        bits = np.unpackbits(np.stack(part, 1).view(np.uint8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
        if i == 0 and scheme.similarity:
            tied = bits[0]
    return np.packbits(total * 2 + tied > len(h), bitorder="little").view(np.uint64), digest


def _lanes(n: int) -> list[str]:
    return [f"f{i}" for i in range(n)]


def fingerprints(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, the lanes f0, f1, ... and the digest of the shingle set (0 without a similarity) of every whole text; a null text is empty."""
    names = _lanes(scheme.lanes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            both = [sized(t, scheme) for t in f["text"]]
            got = np.array([x for x, _ in both], np.uint64).reshape(-1, scheme.lanes).view(np.int64)
            digest = np.array([n for _, n in both], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64")} | {n: got[:, i] for i, n in enumerate(names)} | {"digest": digest})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInPandas(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", digest long")


def _keys(lanes: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, 1 for a cleared bit) of every key. Without a radius a key's lower half is the sketch."""
    bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8), axis=1, bitorder="little")
    m = len(scheme.segments)
    rows, keys, cleared = [], [], []
    power = 1 << np.arange(scheme.width, dtype=np.int64)
    for b, at in enumerate(scheme.places):
        block = bits[:, at]
        if not scheme.radius:
            rows.append(np.arange(len(lanes)))
            keys.append((block @ power | np.int64(b << scheme.width)) << 32 | lanes[:, 0] & ((1 << SKETCH) - 1))
            cleared.append(np.zeros(len(lanes), np.int8))
            continue
        for i, (lo, hi) in enumerate(scheme.segments):
            lo2, hi2 = scheme.segments[(i + 1) % m]
            both = np.concatenate([block[:, lo:hi], block[:, lo2:hi2]], 1).astype(np.int64)
            key = both @ (1 << np.arange(both.shape[1], dtype=np.int64)) | np.int64(b * m + i) << 48
            rows.append(np.arange(len(lanes)))
            keys.append(key)
            cleared.append(np.zeros(len(lanes), np.int8))
            r, c = np.nonzero(both[:, hi - lo :])
            rows.append(r)
            keys.append(key[r] - (np.int64(1) << (c + hi - lo)))
            cleared.append(np.ones(len(r), np.int8))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(cleared)


def _groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of the same rows, sorted by ``by``, that never end inside a group."""
    rest = None
    for f in frames:
        f = f if rest is None else pd.concat([rest, f], ignore_index=True)
        if not len(f):
            continue
        same = np.logical_and.reduce([f[c].to_numpy() == f[c].iloc[-1] for c in by])
        cut = len(f) - int(same.sum())
        if cut:
            yield f.iloc[:cut].reset_index(drop=True)
        rest = f.iloc[cut:]
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def _shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows whose key another row has too, each with its part of the group; sorted by key, streamed without holding a group."""
    last_key, count, held = None, 0, None
    for f in frames:
        if not len(f):
            continue
        key = f["key"].to_numpy()
        new = np.concatenate([[key[0] != last_key], key[1:] != key[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(f)), -1))
        place = np.arange(len(f)) - start
        if not new[0]:
            place[start < 0] = count + np.arange(int((start < 0).sum()))
        shared = place > 0
        shared[:-1] |= place[1:] > 0
        f["part"] = place // GROUP
        if held is not None and place[0] > 0:
            yield held
        held = None
        if not shared[-1]:  # the last row's fate is in the next frame
            held = f.iloc[-1:]
        last_key, count = key[-1], int(place[-1]) + 1
        yield f[shared]


def _alike(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shared rows but for some that are near no other of their group by their sketches, and so can be in no pair.

    Only whole small groups inside a frame are looked at; others are left to ``_linked``, which asks the same of pairs.
    """
    for f in frames:
        key, sketch, keep = f["key"].to_numpy(), f["sketch"].to_numpy(), np.ones(len(f), bool)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(f)))
        first, size = first[1:-1], size[1:-1]  # the outer two may go on in other frames
        for n in np.unique(size[(size > 1) & (size <= SMALL)]):
            at = first[size == n][:, None] + np.arange(n)
            near = np.bitwise_count(sketch[at][:, :, None] ^ sketch[at][:, None, :]) <= SKETCHED
            near[:, np.arange(n), np.arange(n)] = False
            keep[at] = near.any(2)
        yield f[keep].drop(columns="sketch")


def _linked(frames: Iterator[pd.DataFrame], scheme: Scheme) -> Iterator[pd.DataFrame]:
    """Near pairs within each group of (key, x, y): of large ones spanning stars or, where rows have a component c, all pairs across components."""
    names = _lanes(scheme.lanes)
    by = ["key", "x", "y"]
    for f in _groups(frames, by):
        key = f[by].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        size = np.diff(np.append(first, len(f)))
        ids, cleared, lanes = f["id"].to_numpy(), f["cleared"].to_numpy(), f[names].to_numpy().view(np.uint64)
        a, b = [], []

        def near(i, j):  # noqa: B023
            differs = lanes[i] ^ lanes[j]  # noqa: B023
            ok = (np.bitwise_count(differs).sum(-1) <= scheme.limit) & ~((cleared[i] == 1) & (cleared[j] == 1)) & (ids[i] != ids[j])  # noqa: B023
            # the sketch decides pairs, so what ``_alike`` left out beforehand changes nothing
            return ok if scheme.radius else ok & (np.bitwise_count(differs[..., 0] & np.uint64((1 << SKETCH) - 1)) <= SKETCHED)

        for n in np.unique(size[(size > 1) & (size <= SMALL)]):
            at = first[size == n]
            u, v = np.triu_indices(n, 1)
            i, j = (at[:, None] + u).ravel(), (at[:, None] + v).ravel()
            ok = near(i, j)
            a.append(ids[i[ok]])
            b.append(ids[j[ok]])
        apart = f["c"].to_numpy() if "c" in f else None
        for s, n in zip(first[size > SMALL], size[size > SMALL], strict=True):
            at = np.arange(s, s + n)
            if apart is not None:
                for i in at:
                    others = at[(at > i) & (apart[at] != apart[i])]
                    others = others[near(np.full(len(others), i), others)]
                    a.append(np.maximum(ids[others], ids[i]))
                    b.append(np.minimum(ids[others], ids[i]))
                continue
            adjacent = np.stack([near(np.full(n, i), at) for i in at]) | np.eye(n, dtype=bool)
            root = np.arange(n)
            while True:
                lower = np.where(adjacent, root, n).min(1)
                lower = lower[lower]
                if (lower == root).all():
                    break
                root = lower
            star = root != np.arange(n)
            a.append(ids[at[star]])
            b.append(ids[at[root[star]]])
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})


def _keyed(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """key, id, cleared, part (and the one lane of narrow fingerprints) of every key that several nodes have."""
    names = _lanes(scheme.lanes)
    carried = names if scheme.lanes == 1 else []

    def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s in range(0, len(f), 2048):
                part = f.iloc[s : s + 2048]
                rows, keys, cleared = _keys(part[names].to_numpy(np.int64), scheme)
                yield pd.DataFrame({"key": keys, "id": part["id"].to_numpy()[rows], "cleared": cleared} | {n: part[n].to_numpy()[rows] for n in carried})

    columns = "key long, id long, cleared byte" + "".join(f", {n} long" for n in carried)
    keyed = nodes.mapInPandas(explode, columns)
    if scheme.radius:
        shared = keyed.repartition("key").sortWithinPartitions("key", "cleared", "id").mapInPandas(_shared, columns + ", part long")
    else:
        keyed = keyed.repartition(F.shiftright("key", 32)).sortWithinPartitions("key", "id")
        keyed = keyed.select(F.shiftright("key", 32).alias("key"), "id", "cleared", *carried, F.col("key").bitwiseAND(F.lit((1 << SKETCH) - 1)).alias("sketch"))
        shared = keyed.mapInPandas(lambda frames: _alike(_shared(frames)), columns + ", part long")
    return stored(shared, "keys")


def _near(shared: DataFrame, nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """The near pairs (a, b) of ``_keyed`` rows."""
    names = _lanes(scheme.lanes)
    large = shared.groupBy("key").agg(F.max("part").alias("last")).where("last > 0")
    if large.isEmpty():
        shared = shared.select("*", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    else:
        shared = shared.join(large, "key", "left").withColumn("last", F.coalesce("last", F.lit(0)))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))
        shared = shared.withColumn("other", other).select("*", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
    if scheme.lanes > 1:
        shared = shared.join(nodes.select("id", *names), "id")
    component = ["c"] if "c" in shared.columns else []
    shared = shared.select("key", "x", "y", "id", "cleared", *component, *names).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return shared.mapInPandas(lambda frames: _linked(frames, scheme), "a long, b long").distinct()


def links(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """Near pairs (a, b) of ids of ``nodes(id, f0, f1, ...)``, each node another one, enough to connect all that are near."""
    return _near(_keyed(nodes, scheme), nodes, scheme)


def _similar(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """Those of the pairs (a, b) of node ids whose whole shingle sets are similar."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets = [np.unique(hashes(t, scheme.words)) for t in f["text"]]
            digest = np.array([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": f["id"].to_numpy(), "digest": digest, "s": [s.view(np.int64) for s in sets]})

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text")).join(wanted, "id").distinct()
    sets = texts.mapInPandas(run, "id long, digest long, s array<long>")
    sets = stored(sets.join(nodes.select("id", "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]), "sets")
    x, y = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    least, most = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(x, "a").join(y, "b").where(least >= scheme.similarity * most)
    return stored(both.where(common >= scheme.similarity * (least + most - common)).select("a", "b").distinct(), "similar")


def _verified(docs: DataFrame, nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """Links of nodes whose shingle sets are similar, enough to connect all candidates that are."""
    shared = _keyed(nodes, scheme)
    found = _similar(stored(_near(shared, nodes, scheme), "candidates"), docs, nodes, scheme)
    # a star stands for its group only as far as it was verified: the rest are all pairs across what is apart
    big = shared.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select("key")
    big = stored(shared.join(big, "key"), "bunches")
    if big.isEmpty():
        return found
    member = big.join(components(found).withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    split = member.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    rest = _near(stored(member.join(split, "key"), "bunches"), nodes, scheme)
    rest = stored(rest, "candidates")
    return found if rest.isEmpty() else found.union(_similar(rest, docs, nodes, scheme))


def classes(docs: DataFrame, scheme: Scheme = NARROW) -> DataFrame:
    """doc_id, the lanes f0, ... and component_id, the smallest doc_id reachable over links, of every row.

    Texts without words have fingerprint zero and link like any other. Repeated doc_ids are rows of one document.
    Rows with a null doc_id link with nothing and have a null component_id. Other columns are ignored; an empty
    table gives no rows.
    """
    names = _lanes(scheme.lanes)
    same = [*names, "digest"]
    prints = stored(fingerprints(docs, scheme), "fingerprints")
    nodes = stored(prints.where(F.col("doc_id").isNotNull()).groupBy(*same).agg(F.min("doc_id").alias("id")), "nodes")
    # one doc_id with several texts stands for several nodes: it joins them
    several = prints.where(F.col("doc_id").isNotNull()).join(nodes, same).groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b")
    found = components((_verified(docs, nodes, scheme) if scheme.similarity else links(nodes, scheme)).union(several.select("a", "b")))
    reached = nodes.join(found.withColumnRenamed("node", "id"), "id", "left").select(*same, F.coalesce("component", "id").alias("component_id"))
    known = prints.join(reached, same, "left")
    return known.select("doc_id", *names, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, scheme: Scheme = WIDE) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class its smallest doc_id; null doc_ids stay. All columns kept."""
    gone = classes(docs, scheme).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
