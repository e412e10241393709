"""Each operator against a plain version on small inputs with nulls, empty and long texts, ties and repeats."""

import hashlib
import html
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pairloom.llm import bpe, covertree, decontam, dom, htmlextract, licenses, quality, sharding, simhash, substrings, tokenfiles
from pairloom.plans.scratch import Scratch
from tests.same import check, connect

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{k % 2}", None if t is None else len(t)) for k, (i, t) in enumerate(texts)], SCHEMA)


def some_texts(seed=3, n=60):
    r = random.Random(seed)
    base = [[r.choice("abcdef") for _ in range(r.randint(0, 60))] for _ in range(20)]
    out = []
    for k in range(n):
        b = list(r.choice(base))
        if r.random() < 0.5 and b:
            b[r.randrange(len(b))] = "zz"
        out.append((k, " ".join(b)))
    return out + [(500, None), (501, ""), (None, "a b c d e f a b c d"), (7, out[7][1]), (7, "a b c d e f a b c d e f"), (600, "x " * 3000), (601, " \t\n")]


# sharding


def test_hilbert_curve_is_continuous():
    table, bits, n = sharding.hilbert_table(3), 3, 3
    place = {}
    for x in itertools.product(range(1 << bits), repeat=n):
        state, h = 0, 0
        for level in range(bits - 1, -1, -1):
            got = table[state * 8 + sum(((x[k] >> level) & 1) << k for k in range(n))]
            state, h = got >> n, h << n | got & 7
        place[h] = x
    assert len(place) == 512 and all(sum(abs(a - b) for a, b in zip(place[i], place[i + 1])) == 1 for i in range(511))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, law):
    texts = some_texts()
    got = sharding.hilbert_shards(docs_of(spark, texts), law=law).collect()
    assert len(got) == len(texts)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert set(by) <= set(range(8))
    counts = [len(by.get(s, [])) for s in range(8)]
    if law == "rows":
        assert max(counts) - min(counts) <= 1
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in texts)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.hilbert_shards(docs_of(spark, texts).limit(0), law=law).count() == 0


def test_shards_follow_the_curve(spark):
    """Rows in the order of their places, equal texts together, cells of equal depth, ties by doc_id."""
    r = random.Random(12)
    docs = [(k, r.choice(["same words", "w " * r.randint(0, 40), None, f"t{k}"]), r.choice(["en", "de", "fr", None]), f"s{r.randint(0, 5)}") for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = {x["doc_id"]: x for x in sharding.hilbert_shards(df, bits=3).collect()}
    rank = lambda v: (v is not None, v or "")
    place = {}
    for k, t, lang, source in docs:
        own = [(rank(d[3]), rank(d[2])) for d in docs if d[1] == t and t is not None] or [(rank(source), rank(lang))]
        place[k] = min(own), len((t or "").encode()) + 1
    by_place = {}
    for k, p in place.items():
        by_place.setdefault(p, set()).add(got[k]["curve"])
    assert all(len(c) == 1 for c in by_place.values())  # same metadata, same place
    rows = sorted(got.values(), key=lambda x: x["rank"])
    assert [x["rank"] for x in rows] == list(range(400))
    assert [x["curve"] for x in rows] == sorted(x["curve"] for x in rows)
    text = {k: t for k, t, _, _ in docs}
    seen = [text[x["doc_id"]] for x in rows]
    for t in set(seen) - {None}:
        at = [i for i, s in enumerate(seen) if s == t]
        assert at[-1] - at[0] + 1 == len(at) and [rows[i]["doc_id"] for i in at] == sorted(rows[i]["doc_id"] for i in at)
    split = sum(len({got[k]["shard"] for k in text if text[k] == t}) > 1 for t in set(text.values()) - {None})
    assert split <= 7


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_curve_index_of_rows(spark, bits):
    """The column expressions give the table's walk: each cell one place, neighbours in place are neighbours."""
    cells = list(itertools.product(range(1 << bits), repeat=3))
    df = spark.createDataFrame(cells, "a int, b int, c int")
    place = {x["curve"]: (x["a"], x["b"], x["c"]) for x in sharding.with_hilbert_index(df, ["a", "b", "c"], bits).collect()}
    assert sorted(place) == list(range(8**bits))
    assert all(sum(abs(x - y) for x, y in zip(place[i], place[i + 1])) == 1 for i in range(8**bits - 1))


# decontamination


def test_decontamination_is_that_of_sql(spark):
    from pairloom.llm import sql

    check(decontam.op9_decontaminate(spark, SF), connect(SF), sql.OP9)


def longest_matches(w, items, named):
    """Of each item in ``named``: length, place in the text and in the item of the longest run that both have."""
    best = {}
    for i, v in items:
        key = "" if i is None else str(i)
        for p, q in itertools.product(range(len(w)), range(len(v))) if key in named else ():
            n = 0
            while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                n += 1
            if n and (-n, p, q) < best.get(key, (0, 0, 0)):
                best[key] = (-n, p, q)
    return {k: (-n, p, q) for k, (n, p, q) in best.items()}


def test_decontamination_by_brute_force(spark):
    r = random.Random(2)
    words = lambda n: " ".join(r.choice("abcd") for _ in range(n))
    items = [(1, words(30)), (2, words(14)), (3, "Q q!"), (4, None), (5, "--"), (None, words(20)), (2, words(15))]
    docs = [(k, " ".join([words(9), items[k % 3][1] if k % 2 else words(20), words(5)])) for k in range(20)] + [(90, None), (91, ""), (92, "a q, Q b")]
    split = lambda t: (t or "").encode().translate(bytes(decontam.ALNUM_LOWER)).split()

    def plain(t):
        w, hit, named = split(t), set(), set()
        for i, x in items:
            v = split(x)
            size = min(13, len(v))
            for p in range(len(v) - size + 1) if size else ():
                for q in range(len(w) - size + 1):
                    if w[q : q + size] == v[p : p + size]:
                        hit |= set(range(q, q + size))
                        named.add("" if i is None else str(i))
        return len(w), len(hit), sorted(named)

    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, n_hit double")  # a clashing name
    for block in (1_000_000, 25):
        got = {x["doc_id"]: (x["n_words"], x["n_hit"], x["item_ids"]) for x in decontam.scan_benchmark(df, bench, block_words=block).collect()}
        assert got == {i: plain(t) for i, t in docs}
        for x in decontam.scan_benchmark(df, bench, block_words=block).collect():
            if block > 30:  # no item in pieces
                assert {m["item_id"]: tuple(m)[1:] for m in x["matches"]} == longest_matches(split(dict(docs)[x["doc_id"]]), [(i, split(t)) for i, t in items], x["item_ids"])
            assert x["longest"] == max([m["length"] for m in x["matches"]], default=0)
    kept = decontam.drop_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not (h and 20 * h >= n) for n, h, _ in map(plain, [t for _, t in docs]))
    assert decontam.scan_benchmark(df, bench.limit(0)).where("n_hit > 0").count() == 0


# licenses


def test_license_rules():
    assert 200 < len(licenses.rules())
    row = licenses._row
    assert row(None) == row("") == (0, 0, None, None, "", "", 0.0, [])
    n, base, first, last, own, labels, score, _ = row("Released under the MIT license, and CC BY-NC 4.0. SPDX-License-Identifier: GPL-3.0-only")
    assert (n, base, first, last, own, labels) == (18, 2, 1, 6, "cc-by-nc,mit", "cc-by-nc,gpl-3,mit") and 0.9 < score <= 1
    assert row("cc by nc sa")[4:6] == ("cc-by-nc", "cc-by-nc")
    assert row("the art of cooking")[5] == ""
    # a stronger detection hides what lies within it
    assert row("licensed under the GNU General Public License, version 3")[5] == "gpl-3"


def test_license_places_by_brute_force(spark):
    r = random.Random(4)
    pool = "under the mit license apache version 2 cc by nc Foo é".split()
    texts = [(k, " ".join(r.choice(pool) + r.choice(["", ",", "-"]) for _ in range(40))) for k in range(60)]
    texts += [(100 + k, "x under the MIT license y Apache License, Version 2.0; CC-BY-NC") for k in range(2)]
    got = {x["doc_id"]: (x["n_base"], x["first_word"], x["last_word"]) for x in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    for k, t in texts:
        w = t.encode().translate(bytes(licenses.ALNUM_LOWER)).split()
        at = sorted(p for phrase in licenses.BASE for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.encode().split())
        assert got[k] == (len(at), at[0] if at else None, at[-1] if at else None)


def test_license_suppression_by_brute_force():
    r = random.Random(6)
    for _ in range(300):
        spans = [(a, a + r.randint(1, 9), r.randint(0, 3)) for a in (r.randint(0, 12) for _ in range(r.randint(0, 14)))]
        rank = lambda k: (spans[k][2], spans[k][0] - spans[k][1], spans[k][0], k)
        inside = lambda d, e: spans[e][0] <= spans[d][0] and spans[d][1] <= spans[e][1]
        want = [d for d in range(len(spans)) if not any(inside(d, e) and rank(e) < rank(d) for e in range(len(spans)))]
        assert licenses.unsuppressed(spans) == want


def test_license_detections_by_brute_force():
    """All rules on all texts, without prefilter or sorting, then suppression by comparing all detections."""
    r = random.Random(8)
    pool = "licensed under the terms of mit license gnu general public version 2 0 3 cc by nc sa apache spdx identifier bsd clause creative commons é x".split()
    for _ in range(150):
        text = " ".join(r.choice(pool) for _ in range(60))
        every = [(m.start() + 1, m.end(), rule) for rule in licenses.rules() for m in rule.pattern.finditer(f" {text} ")]
        beats = lambda e, d: e[0] <= d[0] and d[1] <= e[1] and (e[2].priority, d[1] - d[0]) < (d[2].priority, e[1] - e[0])
        stay = {(a, b, rule.priority) for a, b, rule in every if not any(beats(e, (a, b, rule)) for e in every)}
        _, base, got, canonical = licenses.scan_text(text)
        assert {(d.start, d.end, d.rule.priority) for d in got} == stay and len({(d.start, d.end) for d in got}) == len(got)
        for d, span in zip(got, licenses._row(text)[7]):
            assert canonical[: d.start].count(" ") - 1 == span["first"] and canonical[d.start : d.end].split() == text.split()[span["first"] : span["last"] + 1]
        missing = 1.0
        for w in [*(d.rule.weight for d in got), *(0.9 for _ in {label for _, label in base})]:
            missing *= 1 - w
        assert licenses._row(text)[6] == (1 - missing if got or base else 0.0)


# BPE and token files


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def odd_texts(n=1500):
    r = random.Random(5)
    pool = list("abcTHE 's'LL\t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　​Åǻ̸ΣΑσς İıßẞﬁ½²٣Ⅷ汉字कि😀<|endoftext|>12_-!?.%&\x00\x7f") + ["<|endoftext|>", "<|startoftext|>", "'re", "the&&&", "x'.", "<|ENDOFTEXT|>"]
    return ["".join(r.choice(pool) for _ in range(r.randint(0, 25))) for _ in range(n)] + ["", "ab" * 3000, "hello world " * 50]


def test_bpe_is_the_library(library):
    own, by_words = bpe.SegmentTreeBPE(bpe.default_path(), cache=50), tokenfiles.LibraryEncoder(bpe.default_path(), cache=100)
    texts = odd_texts()
    for t, ids in zip(texts, by_words.encode_all(texts)):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == want == np.frombuffer(ids, "<u4").tolist()
        assert own.decode(want) == library.decode(want, skip_special_tokens=False).encode()


def test_bpe_of_all_code_points(library):
    """Every code point alone, between letters, beside marks, and beside combining marks."""
    own, by_words = bpe.SegmentTreeBPE(bpe.default_path()), tokenfiles.LibraryEncoder(bpe.default_path())
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    forms = [lambda x: x, lambda x: f"a{x}b"]
    for start in range(0, len(every), 1 << 17):
        part = every[start : start + (1 << 17)]
        if start == 0:
            own_marks = tokenfiles.TAIL.decode()
            forms += [lambda x, k=k: f"a{x}{own_marks[(ord(x) + k) % len(own_marks)]}" for k in (0, 5)]
            forms += [lambda x: f"{x}.", lambda x: f".{x}a", lambda x: f"e\u0301{x},", lambda x: f"{x}\u0301;", lambda x: f"{x}\u0331\u0307!"]
        else:  # ideographs and private use
            forms = forms[:1]
        for form in forms:
            texts = [form(x) for x in part]
            want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
            assert by_words.encode_all(texts) == want
            assert [own.encode(t) for t in texts] == want


def test_bpe_before_every_mark(library):
    """Each letter whose normal form is longer, and a letter of each kind, before every mark."""
    by_words = tokenfiles.LibraryEncoder(bpe.default_path())
    letters = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000 and (len(by_words.library.normalizer.normalize_str(chr(c))) > 1 or c % 97 == 0)]
    texts = [f"a{x}{m}" for x in [*letters, "H\u0331", "J\u030c", "\u1100\u1161", "\u1100\u1161\u11a8"] for m in tokenfiles.TAIL.decode()]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert by_words.encode_all(texts) == want


def test_bpe_of_long_pieces(library):
    """One word of over 2**24 bytes, within a time that only n log n work meets."""
    text = "ab" * (1 << 20) + "." + "the" * 1000
    began = time.time()
    assert np.frombuffer(bpe.SegmentTreeBPE(bpe.default_path()).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert time.time() - began < 120
    keys = [5 << (1 << 25).bit_length() | i for i in range(1 << 24, (1 << 24) + 9)]
    assert bpe.PairTree(keys).node[1] == keys[0]


def test_bpe_columns(spark, library):
    texts = some_texts()
    df = docs_of(spark, texts).withColumn("n_tokens", F.lit("clash"))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_and_decode(df).collect())
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in texts]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted((str(i), len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False).encode())) for (i, _), x in zip(texts, ids))
    back = bpe.decode_column(bpe.encode_column(df)).select("ids", "decoded").collect()
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in back)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    table = tokenfiles.PerfectHash.from_bytes(tokenfiles.PerfectHash.build(keys).to_bytes())
    assert sorted(table.number(keys).tolist()) == list(range(len(keys)))
    assert len(tokenfiles.PerfectHash.build(keys[:0]).levels) == 0


def test_token_files(spark, library):
    texts = some_texts()
    own = Scratch(spark, "tokens")
    manifest = tokenfiles.write_token_files(docs_of(spark, texts), f"{own.path}/files", shards=3, scratch=own)
    rows = sorted(tokenfiles.read_token_files(manifest).collect(), key=lambda r: r["start"])
    assert len(rows) == len(texts) and [r["doc_id"] is None for r in rows[:2]] == [True, False]
    keys = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert keys == sorted(keys)
    at = 0
    for r in rows:
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["ids"][-1] == 1
        at += r["n_tokens"]
    shards = [(r["path"], r["low"], r["high"]) for r in manifest.collect()]
    for key in (0, 7, 501, 600):
        want = sorted(library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts if i == key)
        assert sorted(x.tolist() for x in tokenfiles.lookup(shards, key)) == want
    assert tokenfiles.lookup(shards, 424242) == []
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(docs_of(spark, texts).limit(0), f"{own.path}/none", scratch=own)).count() == 0
    own.drop()


# SimHash


def test_masks_cover():
    masks = simhash.covering_masks(list(range(64)), 3, 1)
    assert len(masks) == 15
    assert all(any(not sum(1 << b for b in bits) & m for m in masks) for bits in itertools.combinations(range(64), 3))


def plain_fingerprint(t):
    w = (t or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(pairs, nodes):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("most", [2, 2000])
def test_simhash_by_brute_force(spark, most):
    texts = [(i, t) for i, t in some_texts(9, 90) if i is not None]
    fp = [(i, plain_fingerprint(t)) for i, t in texts]
    want = roots([(i, j) for (i, x), (j, y) in itertools.combinations(fp, 2) if (x ^ y).bit_count() <= 3], {i for i, _ in fp})
    got = simhash.simhash_components(docs_of(spark, texts), bucket_rows=most).collect()
    assert sorted((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == sorted((i, x, want[i]) for i, x in fp)
    assert simhash.simhash_components(docs_of(spark, texts).limit(0)).count() == 0


# substrings


def plain_removed(rows, size):
    first, key = {}, lambda i: (1 << 63) - 1 if i is None else i
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            first[k] = min(first.get(k, (key(i), p)), (key(i), p))
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < (key(i), p):
                gone |= set(range(p, p + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("size", "prefix", "group"), [(6, 3, 100_000), (6, 3, 3), (8, 2, 5)])
def test_substrings_by_brute_force(spark, size, prefix, group):
    texts = some_texts()
    df = docs_of(spark, texts).withColumnRenamed("lang", "copy")  # a name that the operator uses itself
    got = substrings.remove_repeats(df, window=size, prefix=prefix, group_rows=group)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == plain_removed(texts, size)
    assert got.where("n_removed = 0 AND doc_id = 600").count() == 0
    assert substrings.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("share", [4096, 40])
def test_substrings_with_hot_prefixes(spark, monkeypatch, share):
    """A passage, a line shorter than a window and a group of copies that a third of all documents have; long words; hot or not."""
    monkeypatch.setattr(substrings, "HOT_SHARE", share)
    r = random.Random(11)
    draw = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    passage, line, copy = draw(45), draw(14), draw(70)
    texts = [(k, copy if k % 3 == 0 else " ".join([draw(r.randint(0, 30)), passage if k % 3 == 1 else line, draw(r.randint(0, 30))])) for k in range(900)]
    long = " ".join([draw(9), "y" * 3000, draw(9), "z" * 100, draw(9)])
    texts += [(1000, long), (1001, "q " + long), (1002, long.replace("z" * 100, "z" * 99 + "x")), (None, passage), (None, passage + " end"), (5, copy), (1003, "q " * 400)]
    got = substrings.remove_repeats(docs_of(spark, texts), kept_col=None)
    assert sorted((str(x["doc_id"]), x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got.collect()) == plain_removed(texts, 20)
    own = Scratch(spark, "hot")
    plain = docs_of(spark, texts).selectExpr("coalesce(doc_id, 0) AS doc", "xxhash64(text) AS t1", "text")
    assert (len(substrings._hot_prefixes(plain, 20, 8, own)) > 0) == (share == 40 or len(texts) > 256)
    own.drop()


# embeddings


@pytest.mark.parametrize("block", [4096, 40])
def test_near_vectors_by_brute_force(spark, block):
    g = np.random.default_rng(2)
    rows = []
    for _ in range(70):
        c = g.normal(size=12)
        for _ in range(g.integers(1, 5)):
            rows.append((len(rows), (c + g.normal(size=12) * g.choice([0, 0.05, 0.2, 0.3, 0.5])).astype(np.float32).tolist(), int(g.integers(0, 3))))
    k = len(rows)
    rows += [(k + i, rows[5][1], rows[5][2]) for i in range(20)]
    rows += [(k + 30, None, 1), (k + 31, [0.0] * 12, 1), (k + 32, [float("nan")] * 12, 1), (k + 33, [1.0, 2.0], 1), (k + 34, [2.0, 4.0], 1), (k + 35, rows[5][1], None), (k + 36, [], 2), (k + 37, [1.0, None], 1)]
    good = [(i, lab, np.array(v, float)) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(i, j) for (i, a, v), (j, b, w) in itertools.combinations(good, 2) if a == b and len(v) == len(w) and v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= 0.93]
    top = roots(links, {r[0] for r in rows})
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in covertree.near_vectors(df, block_rows=block).collect()}
    assert got == {i: (sum(i in x for x in links), top[i], top[i] == i) for i, _, _ in rows}
    assert covertree.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 10])
def test_vectors_with_null_ids(spark, block):
    """Null ids within classes, as whole classes, and as the only way between two ids; other columns with clashing names."""
    g = np.random.default_rng(5)
    turn = lambda a: [float(np.cos(a)), float(np.sin(a))]
    rows = [(None, turn(0.0)), (None, turn(0.0)), (None, turn(0.3)), (9, turn(0.6)), (4, turn(0.9)), (None, turn(3.0)), (7, turn(4.0)), (None, turn(4.0)), (None, None)]
    rows += [(int(k) if k % 3 else None, turn(float(a))) for k, a in enumerate(g.uniform(0, 60, 40), 20)]
    rows = [(i, v, 1, f"row{k}") for k, (i, v) in enumerate(rows)]
    every = range(len(rows))
    links = [(a, b) for a, b in itertools.combinations(every, 2) if rows[a][1] and rows[b][1] and np.dot(rows[a][1], rows[b][1]) / (np.linalg.norm(rows[a][1]) * np.linalg.norm(rows[b][1])) >= 0.93]
    top = roots(links, set(every))
    want = []
    for k in every:
        ids = [rows[j][0] for j in every if top[j] == top[k] and rows[j][0] is not None]
        least = min(ids, default=None)
        want.append((rows[k][0], sum(k in x for x in links), least, rows[k][0] == least))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")
    got = [tuple(r) for r in covertree.near_vectors(df, block_rows=block).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


# pages


def test_pages_of_known_parts():
    model = htmlextract.trained()
    page = """<html><head><title>T</title><script>x="</p>"</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies. Accept them all.</p></div><article><h1>The &amp; title</h1><p>First <b>bold</b>word
    here.<br>Second line, with more words in it than before.<p>Unclosed paragraph goes on for a while, as they do.</p><div class="ad">Buy this now, it is cheap.</div></article>
    <aside class="sidebar"><p>Other things that you may like to read.</p></aside><div id="comments"><p>I think that this is wrong, and here is why.</p></div>
    <form><label>Search</label><input></form><footer>&copy; Someone. All rights.</footer></body></html>"""
    assert model.extract(page) == "The & title First boldword here. Second line, with more words in it than before. Unclosed paragraph goes on for a while, as they do."
    assert model.extract(None) == model.extract("") == "" and model.extract("just text") == "just text"
    assert model.extract("<p>cut off &amp; <b") == "cut off &"


def plain_nodes(page):
    """Tags and texts as the parser gives them."""
    return [(n.tag, n.text) for n in dom.parse(page)]


def test_end_tags_close_what_is_nearest():
    assert plain_nodes("<div>a<i><p>b</i>c</p>d</div>e") == [("#root", ""), ("div", ""), ("#text", "a"), ("p", ""), ("#text", "bc"), ("#text", "d"), ("#text", "e")]
    assert plain_nodes("<ul><li>a<b>x<li>b<ul><li>c</ul>d</ul>") == [("#root", ""), ("ul", ""), ("li", ""), ("#text", "ax"), ("li", ""), ("#text", "b"), ("ul", ""), ("li", ""), ("#text", "c"), ("#text", "d")]
    assert plain_nodes("<table><tr><td>a<td>b<tr><td>c</table>d") == [("#root", ""), ("table", ""), ("tr", ""), ("td", ""), ("#text", "a"), ("td", ""), ("#text", "b"), ("tr", ""), ("td", ""), ("#text", "c"), ("#text", "d")]
    assert plain_nodes("<h2>a</h3>b") == [("#root", ""), ("h2", ""), ("#text", "a"), ("#text", "b")]


@pytest.mark.parametrize("page", ["<b>" * 60_000 + "x</i>" * 60_000, "<i><div>" + "<b>" * 60_000 + "x</i>" * 60_000, "<div>" * 60_000 + "<tr>x</tr>" * 60_000, "<p>word &amp; word</p>\n" * 40_000, "<li>a<div>" * 60_000])
def test_long_pages_in_linear_time(page):
    began = time.time()
    htmlextract.trained().extract(page)
    assert time.time() - began < 60


def test_long_texts_in_linear_time():
    """A text of 10 MB full of phrases."""
    text = "released under the MIT license, see Apache License, Version 2.0; " * 150_000
    began = time.time()
    n, n_base, first, last, *_ = licenses._row(text)
    assert (n_base, first, last) == (300_000, 1, n - 5) and time.time() - began < 120


def test_marginals_are_exact():
    """Messages give what summing over all labelings gives."""
    model = htmlextract.trained(200)
    nodes = dom.parse("<body><div class=ad>a b.</div><article><p>c d e f g.</p></article></body>")
    got = model.marginals(nodes)
    weight = np.zeros((len(nodes), 2))
    for y in itertools.product((0, 1), repeat=len(nodes)):
        w = 1e-3 if not y[0] else 1.0
        for i in range(1, len(nodes)):
            r = sum(model.evidence.get(f, 0.0) for f in htmlextract.features(nodes[i], nodes))
            e = next((model.edges[k] for k in htmlextract._keys(nodes[i], nodes) if k in model.edges), (0.9, 0.1, 0.5, 0.5))
            w *= (1 / (1 + np.exp(-r)) if y[i] else 1 / (1 + np.exp(r))) * e[2 * y[nodes[i].parent] + y[i]]
        for i, v in enumerate(y):
            weight[i, v] += w
    assert np.allclose(got, weight[:, 1] / weight.sum(axis=1), atol=1e-9)


def test_held_out_pages():
    model, maker = htmlextract.trained(), htmlextract.PageMaker(99)
    hit = over = miss = 0
    for _ in range(120):
        nodes, labels = htmlextract.labelled(maker.page())
        for n, y, p in zip(nodes, labels, model.marginals(nodes)):
            if n.tag == "#text" and not n.unseen:
                size = len(n.text.split())
                hit, over, miss = hit + size * (y and p > 0.5), over + size * (not y and p > 0.5), miss + size * (y and p <= 0.5)
    assert hit / (hit + over) > 0.95 and hit / (hit + miss) > 0.95


def by_template(page):
    """The article of a given page, read by the template that these pages have."""
    inside = re.search(r"<article[^>]*>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h[1-6]|ul|ol|li|table|tbody|tr|td|th|blockquote|pre)\b[^>]*>", re.sub(r"<!--.*?-->", "", inside, flags=re.S))
    plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in blocks]
    return " ".join(b for b in plain if b)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    want = {r["page_id"]: by_template(r["html"]) for r in pages.collect()}
    got = htmlextract.op1_html_text(spark, "/root/testdata/sf0.01").collect()
    assert len(want) == len(got) > 200 and all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)


def test_page_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>Hello there, you.</p>", "x"), (2, None, None, "y"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in htmlextract.extract_text(df).collect()) == [(1, "Hello there, you.", 17), (2, "", 0), (2, "", 0)]


# quality


def test_quality_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").select("text", "quality", "toxic").collect()
    rows = [tuple(r) for r in d]
    random.Random(1).shuffle(rows)
    half = len(rows) // 2
    e = quality.Evidence.fit(rows[:half])
    texts = [r[0] for r in rows[half:]]
    bad = (e.low_quality(texts) > 0) | (e.toxic(texts) > 0)
    truth = np.array([r[1] == 0 or r[2] == 1 for r in rows[half:]])
    assert bad[~truth].mean() < 0.02 and (e.low_quality(texts) > 0)[[r[1] == 0 for r in rows[half:]]].mean() > 0.9


def test_quality_edges(spark):
    df = docs_of(spark, some_texts()).withColumn("keep", F.lit("clash")).withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("source")))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.score_documents(df, quality.fit_evidence(df, labels))
    assert out.count() == df.count() and out.where("NOT keep").count() == 0
    assert quality.drop_rejected(df, labels).columns == df.columns
    assert quality.score_documents(df.limit(0), quality.Evidence.fit([])).count() == 0


def test_evidence_is_that_of_whole_rows(spark):
    """Fitted on the cluster: what fitting in one place gives; by the plain formulas, host and path posteriors of every row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [tuple(r) for r in docs.join(labels, "doc_id").select("text", "quality", "toxic").collect()]
    e, want = quality.fit_evidence(docs, labels), quality.Evidence.fit(rows)
    assert np.allclose(e.weights, want.weights, atol=1e-6) and e.words.keys() == want.words.keys() and np.isclose(e.base, want.base)
    few = quality.fit_evidence(docs.unionAll(docs), labels, max_labelled=20)  # repeated ids: bounded again after the join
    assert few.weights.shape == e.weights.shape
    got = {r["doc_id"]: r for r in quality.score_documents(docs, e, keep_text=False).collect()}
    p = lambda x: 1 / (1 + math.exp(-x))
    low, toxic, site = {}, {}, {}
    for r in docs.collect():
        k = r["doc_id"]
        low[k], toxic[k], site[k] = float(e.low_quality([r["text"]])[0]), float(e.toxic([r["text"]])[0]), (r["source"], r["lang"])
    bad = {k: 1 - (1 - p(low[k])) * (1 - p(toxic[k])) for k in low}
    host = {h: [bad[k] for k in bad if site[k][0] == h] for h in {s[0] for s in site.values()}}
    path = {s: [bad[k] for k in bad if site[k] == s] for s in set(site.values())}
    n, s = len(bad), sum(bad.values())
    rate = min(max(s / n, 1e-4), 1 - 1e-4)
    between = sum(sum(x) ** 2 / len(x) for x in host.values()) - n * rate * rate
    spread = max((between - (len(host) - 1) * rate * (1 - rate)) / max(n - sum(len(x) ** 2 for x in host.values()) / n, 1e-9), rate * (1 - rate) / 1000)
    strength = max(rate * (1 - rate) / spread - 1, 1.0) if len(host) > 1 else 100.0
    for k, r in got.items():
        hr = (sum(host[site[k][0]]) + strength * rate) / (len(host[site[k][0]]) + strength)
        pr = (sum(path[site[k]]) + strength * hr) / (len(path[site[k]]) + strength)
        shift = max(-2.0, min(2.0, math.log(pr / (1 - pr)) - math.log(rate / (1 - rate))))
        odds = math.log(math.exp(low[k]) + math.exp(toxic[k])) + shift
        assert np.allclose([r["low_quality"], r["toxic"], r["host_rate"], r["path_rate"], r["bad"], r["score"]], [low[k], toxic[k], hr, pr, odds, 1 / (1 + math.exp(odds))], atol=1e-8)
        assert r["keep"] == (odds < 0)


def test_sites_are_shrunk():
    rate, strength = quality._prior(3, 300, 60.0, 100 * (0.2**2) * 3, 30000)
    assert rate == 0.2 and strength > 100  # hosts that do not differ: a strong prior
    assert quality._prior(2, 200, 100.0, 100 * (0.9**2 + 0.1**2), 20000)[1] < 5  # hosts that do: a weak one


# whole queries and very long texts


@pytest.mark.parametrize("name", ["op3_cover_tree_pairs", "op7_suffix_tree_dedup"])
def test_same_rows_as_sql(spark, name):
    from pairloom.llm.queries import oracle_sql, queries

    check(queries()[name](spark, SF), connect(SF), oracle_sql()[name])


def test_very_long_texts(spark):
    """A text of 8 MB twice and a word of 8 MB through the operators on documents, within a bound that only near-linear work meets."""
    r = random.Random(4)
    pool = [f"w{k}" for k in range(5000)]
    long = " ".join(r.choices(pool, k=1_500_000))
    texts = [(1, long), (2, long), (3, "y" * 8_000_000), (4, " ".join(long.split()[:40]) + " end")]
    df = docs_of(spark, texts).cache()
    n = {i: len(t.split()) for i, t in texts}
    began = time.time()
    got = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in substrings.remove_repeats(df, kept_col=None).collect()}
    assert got == {1: (n[1], 0), 2: (n[1], n[1]), 3: (1, 0), 4: (41, 40)}
    bench = spark.createDataFrame([(7, " ".join(long.split()[100:160])), (8, "none of these words")], "item_id long, text string")
    found = {x["doc_id"]: (x["n_words"], x["n_hit"], [m["length"] for m in x["matches"]]) for x in decontam.scan_benchmark(df, bench).collect()}
    assert found == {1: (n[1], 60, [60]), 2: (n[1], 60, [60]), 3: (1, 0, []), 4: (41, 0, [])}
    marked = {x["doc_id"]: x["component_id"] for x in simhash.simhash_components(df).collect()}
    assert marked[1] == marked[2] == 1 and marked[3] == 3
    assert {x["doc_id"]: x["size"] for x in sharding.hilbert_shards(df).collect()} == {i: len(t) + 1 for i, t in texts}
    assert quality.score_documents(df, quality.Evidence.fit([]), keep_text=False).count() == 4
    own = Scratch(spark, "tokens")
    rows = {x["doc_id"]: x["n_tokens"] for x in tokenfiles.read_token_files(tokenfiles.write_token_files(df.where("doc_id != 3"), f"{own.path}/files", shards=2, scratch=own), with_ids=False).collect()}
    assert rows == {x["doc_id"]: x["n_tokens"] + 1 for x in bpe.encode_and_decode(df.where("doc_id != 3")).collect()}
    own.drop()
    assert time.time() - began < 400
