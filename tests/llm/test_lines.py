import random
import re

from quillmart.llm import lines, queries

DOCS = "doc_id long, text string, band string, h1 long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def normal(s):
    return " ".join(s.lower().split())


def shingles(n):
    return {n[i : i + 5] for i in range(max(1, len(n) - 4))}


def brute(docs, t=0.8):
    """Which lines stay, comparing all pairs of distinct lines."""
    at = {}
    for d, text in sorted(docs):
        for p, s in enumerate(text.split("\n")):
            if normal(s):
                at.setdefault(normal(s), []).append((d, p))
    keys, sets = list(at), [shingles(k) for k in at]
    root = list(range(len(keys)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    first = {}
    for i, k in enumerate(keys):
        first[top(i)] = min(first.get(top(i), (9e9, 0)), at[k][0])
    keep = set(first.values())
    return {d: "\n".join(s for p, s in enumerate(x.split("\n")) if not normal(s) or (d, p) in keep) for d, x in docs}


def test_op7_against_all_pairs(spark):
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefgh", k=draw.randrange(2, 9))) for _ in range(500)]
    base = [draw.choices(words, k=draw.randrange(5, 40)) for _ in range(60)]
    docs = []
    for d in range(80):
        out = []
        for _ in range(6):
            w = list(draw.choice(base))
            if draw.random() < 0.5:
                w[draw.randrange(len(w))] = draw.choice(words)
            if draw.random() < 0.2:
                w = draw.choices(words, k=20)
            out.append(draw.choice(["", "  "]) + " ".join(w).capitalize() + draw.choice(["", "", "\n"]))
        docs.append((d, "\n".join(out)))
    got = {r.doc_id: r.text for r in lines.dedup(frame(spark, docs)).collect()}
    want = brute(docs)
    lost = sum(len(got[d].split("\n")) - len(t.split("\n")) for d, t in want.items())
    whole = sum(len(t.split("\n")) for t in want.values())
    assert all(set(want[d].split("\n")) <= set(got[d].split("\n")) for d in want)  # nothing that should stay goes
    assert lost <= 0.01 * whole


def test_one_large_band_is_linked_whole(spark):
    """Hundreds of variants of one line, each with one word of its own, and a chain that strays from them."""
    words = [f"word{i:02d}xyz" for i in range(40)]
    docs = [(i, " ".join(words[: i % 40] + [f"other{i:04d}z"] + words[i % 40 + 1 :])) for i in range(400)]
    got = lines.dedup(frame(spark, docs)).where("_removed = 0").collect()
    assert [r.doc_id for r in got] == [0]


def test_large_groups_are_split_and_lose_no_link(spark, monkeypatch):
    """Variants of one line that are about 0.7 alike, with near pairs among them; groups too large for one task."""
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(60)]
    docs = []
    for i in range(120):
        w = [x if draw.random() < 0.94 else f"{i:06d}" for x in words]
        docs.append((2 * i, " ".join(w)))
        w[draw.randrange(60)] = "other"
        docs.append((2 * i + 1, " ".join(w)))
    want = sum(t == "" for t in brute(docs).values())
    monkeypatch.setattr(lines, "LEVELS", 1)
    for size in (2048, 40):
        monkeypatch.setattr(lines, "GROUP", size)
        got = lines.dedup(frame(spark, docs)).where("_removed > 0").count()
        assert abs(got - want) <= 0.01 * want, (size, got, want)


def test_recall_at_the_threshold():
    """Pairs of lines between 0.80 and 0.85 alike share a band and pass the sketch."""
    draw = random.Random(5)
    for scheme in (lines.Bands.of(n, 0.8) for n in (10**4, 10**7, 10**11)):
        assert _recall(draw, scheme) >= 0.98


def _recall(draw, scheme):
    found = of = 0
    while of < 300:
        w = ["".join(draw.choices("abcdefghijkl", k=draw.randrange(3, 9))) for _ in range(50)]
        v = list(w)
        for k in draw.sample(range(50), 4):
            v[k] = "".join(draw.choices("abcdefghijkl", k=5))
        x, y = " ".join(w), " ".join(v)
        if 0.8 <= len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y)) <= 0.85:
            bands, note = lines.signed([x, y], scheme)
            of, found = of + 1, found + bool((bands[0] == bands[1]).any() and lines._alike(note[:1], note[1:])[0])
    return found / of


def test_common_shingles():
    draw = random.Random(2)
    texts = ["".join(draw.choices("ab", k=draw.randrange(1, 90))) for _ in range(40)]
    inter, size = lines.common_shingles(texts)
    for i, x in enumerate(texts):
        assert size[i] == len(shingles(x)) == len(lines.distinct([x])[0])
        assert all(inter[i, j] == len(shingles(x) & shingles(y)) for j, y in enumerate(texts) if i != j)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "same line\n\nsame  LINE\n"), (4, "same line"), (None, "same line"), (5, "x" * 90000 + " y"), (5, "x" * 90000 + " y"), (6, "日本語の文章です。日本語の文章です。"), (7, "日本語の文章です。日本語の文章です。")]
    out = lines.dedup(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "band", "h1", "_lines", "_removed"]
    got = sorted(((r.doc_id or 0), r.text if r.text is None else r.text[:20], r._removed) for r in out.collect())
    assert got == [(0, "same line", 0), (1, None, 0), (2, "", 0), (3, "same line\n\n", 1), (4, "", 1), (5, "", 1), (5, "x" * 20, 0), (6, "日本語の文章です。日本語の文章です。", 0), (7, "", 1)]
    assert sorted(r.doc_id or 0 for r in lines.without_repeats(frame(spark, rows)).collect()) == [0, 1, 2, 3, 5, 6]
    clash = frame(spark, rows).withColumnsRenamed({"band": "_lines", "h1": "_removed"})
    out = lines.without_repeats(clash)
    assert out.columns == ["doc_id", "text", "_lines", "_removed"] and {(r._lines, r._removed) for r in out.collect()} == {("x", 1)}
    assert lines.dedup(clash).columns == ["doc_id", "text", "_lines", "_removed"]
    assert lines.dedup(frame(spark, [])).count() == 0


def test_rows_of_one_doc_id_are_decided_apart(spark):
    a, b, c = ("".join(random.Random(k).choices("abcdefgh ", k=60)) for k in range(3))
    got = sorted((r.doc_id, r.text, r._removed) for r in lines.dedup(frame(spark, [(1, a), (2, a), (2, b)])).collect())
    assert got == sorted([(1, a, 0), (2, "", 1), (2, b, 0)])
    got = sorted((r.doc_id, r.text, r._removed) for r in lines.dedup(frame(spark, [(1, a), (1, a)])).collect())
    assert got == [(1, "", 1), (1, a, 0)]
    many = [(3, a + "\n" + b)] * 40 + [(3, c), (4, b), (None, a)]
    out = lines.dedup(frame(spark, many).repartition(5)).collect()
    assert sum(r._removed for r in out) == 2 * 39 + 1
    assert sorted(t for r in out if r.doc_id for t in r.text.split("\n") if t) == sorted([a, b, c])


def test_op7_on_the_documents(spark, sf):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    got = {r.doc_id: r for r in queries.op7_fuzzy_lines(spark, sf).collect()}
    assert len(got) == len(docs)
    wrong = sum(got[d].n_lines - got[d].n_removed != (len(t.split("\n")) if t else 0) for d, t in want.items() if t)
    assert wrong <= 2
