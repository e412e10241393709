"""The pipeline's near-dedup stage against all pairs by five-word Jaccard similarity."""

import itertools
import random

import corpus_pipeline as P
import numpy as np
import pytest

from pairloom.llm import nearcopies
from tests.llm.test_operators import roots


def words(text):
    got = (text or "").encode().lower().split()
    return {tuple(got[i : i + 5]) for i in range(max(1, len(got) - 4))}


def near(a, b):
    x, y = words(a), words(b)
    return 10 * len(x & y) >= 8 * len(x | y)


def made(seed):
    r = random.Random(seed)
    draw = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    line, texts = draw(40), ["", None, " ", "one two", "ONE two"]
    for _ in range(25):
        base = draw(r.randrange(5, 300)) + (line if r.random() < 0.5 else [])
        for edits in [0, *(r.randrange(0, 1 + len(base) // 40) for _ in range(6))]:
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = "new" + str(r.randrange(99))
            texts.append(" ".join(copy))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, centres, block, rounds", [(1, 4, 8192, 2), (2, 1, 8192, 0), (3, 1, 3, 1)])
def test_near_copies_by_brute_force(spark, monkeypatch, seed, centres, block, rounds):
    monkeypatch.setattr(nearcopies, "ROUNDS", rounds)
    monkeypatch.setattr(nearcopies, "CENTRES", centres)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    texts = made(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = [(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if near(a, b)]
    assert len(pairs) > 100
    got = [r["doc_id"] for r in P.near_copies(spark, docs, "").collect()]
    assert sorted(got) == sorted(set(roots(pairs, set(range(len(texts)))).values()))


@pytest.mark.parametrize("centres, size", [(1, 2), (2, 3), (4, 1), (4, 7)])
def test_buckets_over_batches(monkeypatch, centres, size):
    """Pairs with the least classes and rows of large buckets, however the rows are cut into batches."""
    monkeypatch.setattr(nearcopies, "CENTRES", centres)
    r = random.Random(size)
    tokens = sorted(r.choice(range(8)) for _ in range(40))
    rows = np.array([(t, k, 10, 0, *(0,) * 4) for k, t in enumerate(tokens)], np.int64)
    cut = [rows[k : k + size] for k in range(0, len(rows), size)]
    got = [b.to_pylist() for b in nearcopies._spread(nearcopies._batch(c, nearcopies.ROW) for c in cut)]
    got = [x for b in got for x in b]
    want, back = set(), set()
    for t in set(tokens):
        own = [k for k, x in enumerate(tokens) if x == t]
        want |= {(a, b) for i, a in enumerate(own[:centres]) for b in own[i + 1 :]}
        back |= set(own) if len(own) > centres + 1 else set()
    assert {(x["a"], x["b"]) for x in got if x["a"] is not None} == want and sum(x["a"] is not None for x in got) == len(want)
    assert sorted(x["cls"] for x in got if x["cls"] is not None) == sorted(back)
    met = [x["cls"] for b in nearcopies._met(nearcopies._batch(c[:, [0, 1, 3]], nearcopies.PLACE) for c in cut) for x in b.to_pylist()]
    assert met == [k for k, t in enumerate(tokens) if tokens.count(t) > 1]


def test_repeated_and_null_ids(spark):
    a, b = "a b c d e f g h", "one two three four five six"
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (2, b), (None, b), (None, "x y"), (None, "x y")], "doc_id long, text string")
    assert sorted(map(str, map(tuple, P.near_copies(spark, docs, "").collect()))) == sorted(map(str, [(1, a), (2, b), (None, "x y")]))


def test_given_documents_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], words(r["text"])) for r in docs.collect()]
    pairs = [(i, j) for (i, x), (j, y) in itertools.combinations(rows, 2) if 10 * len(x & y) >= 8 * len(x | y)]
    got = P.near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(roots(pairs, {i for i, _ in rows}).values()))


def test_fingerprints_by_covering_tables(spark, tmp_path, monkeypatch):
    """The stage's first pairs come from the SimHash fingerprints of five-word runs, by the covering tables."""
    from pairloom.llm.simhash import fingerprint, shingle_hashes

    asked = []
    real = nearcopies.link_fingerprints
    monkeypatch.setattr(nearcopies, "link_fingerprints", lambda classes, own, radius: asked.append((sorted(r["fp"] for r in classes.collect()), radius)) or real(classes, own, radius))
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base), " ".join([*base, "end"]), " ".join(reversed(base)), "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in P.near_copies(spark, docs, "").collect()) == [0, 2, 3]
    fps = {int(np.array([fingerprint(np.unique(shingle_hashes(t, 5)))], np.uint64).view(np.int64)[0]) for t in texts}
    assert asked == [(sorted(fps), 3)]


def test_picked_rows(spark):
    rows = spark.createDataFrame([(k, str(k)) for k in range(-500, 500)], "k long, v string")
    bits = nearcopies._marks(rows.where("k % 7 = 0").select("k"))
    some, rest = (sorted(r["k"] for r in nearcopies._picked(rows, "k", bits, m).collect()) for m in (True, False))
    assert some == [k for k in range(-500, 500) if k % 7 == 0] and sorted(some + rest) == list(range(-500, 500))
    assert nearcopies._picked(rows, "k", None).count() == 1000 and nearcopies._picked(rows, "k", None, False).count() == 0


def test_no_text_moves_for_long_unlike_texts(spark, monkeypatch):
    """Long texts that share a passage stand in one bucket and pass 256 bits; their sketches tell them apart."""
    from pairloom.plans.scratch import Scratch

    held, placed = [], []
    real = Scratch.write

    def write(self, df, name="t"):
        out = real(self, df, name)
        if name in ("held", "placed"):
            (held if name == "held" else placed).append(out.count())
        return out

    monkeypatch.setattr(Scratch, "write", write)
    r = random.Random(5)
    draw = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    # runs are ordered rarest first, so the passage stands among the first runs only where a sample does not show it
    monkeypatch.setattr(nearcopies, "HOT", 1)
    passage, short = draw(300), draw(30)
    texts = [" ".join([*draw(500), *passage, *draw(500)]) for _ in range(12)] + [" ".join([*short, *draw(12 + k)]) for k in range(12)]
    texts.append(texts[0] + " more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x["doc_id"] for x in P.near_copies(spark, docs, "").collect()) == list(range(24))
    assert sum(held) <= 4  # both texts of the one pair of near copies, whenever it is met
    assert len(placed) > 1 and placed[1] < placed[0]  # rows that met no class of another component are not dealt again


@pytest.mark.parametrize("seed", range(3))
def test_sketches_lose_no_pair(seed):
    """Sketches of whatever lengths differ in no more bits than sets do in runs."""
    r = np.random.default_rng(seed)
    for n in (1, 2, 255, 256, 257, 3000):
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate((x[: n - n // 9], r.integers(0, 1 << 63, n // 3).astype(np.uint64))))
        apart = len(np.setxor1d(x, y))
        assert nearcopies.bits_apart(nearcopies.sketch(x), nearcopies.sketch(y)) <= apart
    z = np.unique(r.integers(0, 1 << 63, 3000).astype(np.uint64))
    assert 9 * nearcopies.bits_apart(nearcopies.sketch(x), nearcopies.sketch(z)) > len(x) + len(z)


def test_unlike_long_texts_meet_once(spark, monkeypatch):
    """Long unlike texts that share a passage give a row for each that the first round is dealt, and none later."""
    from pairloom.plans.scratch import Scratch

    made, placed = [], []
    real = Scratch.write

    def write(self, df, name="t"):
        out = real(self, df, name)
        if name in ("others", "placed"):
            (made if name == "others" else placed).append(out.count())
        return out

    monkeypatch.setattr(Scratch, "write", write)
    monkeypatch.setattr(nearcopies, "HOT", 1)
    r = random.Random(7)
    draw = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage = draw(300)
    texts = [" ".join([*draw(600), *passage, *draw(600)]) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x["doc_id"] for x in P.near_copies(spark, docs, "").collect()) == list(range(20))
    assert 200 < made[0] <= placed[0]
    assert sum(made[1:]) == 0


@pytest.mark.parametrize("size, narrow, compared", [(1, 1 << 14, 1 << 23), (7, 1 << 14, 1000), (400, 512, 1)])
def test_sketches_of_buckets(monkeypatch, size, narrow, compared):
    """Of two blocks of a bucket no similar pair is lost and no unlike one stays, however rows are cut; a row without a sketch meets by 256 bits."""
    import pyarrow as pa

    monkeypatch.setattr(nearcopies, "NARROW", narrow)
    monkeypatch.setattr(nearcopies, "COMPARED", compared)
    r = np.random.default_rng(3)
    fresh = lambda n: r.integers(0, 1 << 63, n).astype(np.uint64)
    sets = []
    for n in (300, 700, 700, 1500, 3000):
        base = fresh(n)
        sets += [np.unique(np.concatenate((base[k * n // 60 :], fresh(k * n // 60)))) for k in range(4)]
    sets += [sets[4], fresh(20)]
    known = {k for k in range(len(sets)) if k not in (5, len(sets) - 1)}
    rows = [(t, k, len(w), 0, *nearcopies.folded(w), k, k % 2, i, j) for t in (1, 2) for i, j in ((0, 0), (0, 1), (1, 1)) for k, w in enumerate(sets) if k % 2 in (i, j)]
    names = [*nearcopies.ROW, "c", "own", "i", "j"]
    whole = nearcopies._batch(np.array(rows, np.int64), names).append_column("sketch", pa.array([nearcopies.sketch(sets[x[1]]) if x[1] in known else None for x in rows], pa.binary()))
    cut = [whole.slice(k, size) for k in range(0, whole.num_rows, size)]
    similar = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if nearcopies.similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]) + len(sets[b]))}
    pairs = [(x["a"], x["b"]) for b in nearcopies._others(iter(cut), False) for x in b.to_pylist()]
    assert len(pairs) == 2 * len(set(pairs)) and similar <= set(pairs) and len(similar) > 20
    if narrow > 512:
        assert all({5} & set(p) or p[0] // 4 == p[1] // 4 or 20 in p for p in pairs)
    near = [x for b in nearcopies._others(iter(cut), True) for x in b.to_pylist()]
    assert {x["cls"] for x in near} == {k for p in pairs for k in p}
    assert {(x["a"], x["b"]) for x in near} <= set(pairs) and all(x["cls"] in (x["a"], x["b"]) for x in near)
