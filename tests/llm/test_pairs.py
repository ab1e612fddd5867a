"""Decontamination and the similarity join against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodex.llm import decontam, jaccard
from lodex.llm.common import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOW))


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_words():
    for t in ["Ab-c Éd_1\n\x1f日本 x", "", " .,", "É É", "a\x00b\x7fc"]:
        assert [w.decode() for w in words(t.encode())] == plain_words(t)
    assert words(None) == []


def expected(docs, bench, window=10):
    items = {}
    for i, t in bench:
        w = plain_words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            items.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, ids = plain_words(t), set(), set()
        for n in {len(k) for k in items}:
            for k in range(len(w) - n + 1):
                if own := items.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= own
        out.append((i, len(w), len(hit), tuple(sorted(ids))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_windows, piece", [(10**6, 2000), (20, 4)])
def test_decontamination(frame, monkeypatch, block_windows, piece):
    monkeypatch.setattr(decontam, "PIECE", piece)
    rng = random.Random(5)
    bench = [(i, sentence(rng, rng.choice([3, 9, 10, 25]))) for i in range(12)] + [(12, None), (13, ""), (14, "...")]
    bench += [(20, bench[3][1]), (3, bench[3][1])]
    docs = [(i, sentence(rng, 60)) for i in range(20)]
    docs += [(100 + i, f"{sentence(rng, 20)}! {t.upper() if t else ''}, {sentence(rng, 5)}") for i, t in bench[:12]]
    docs += [(200, None), (201, ""), (202, bench[0][1]), (202, bench[0][1]), (203, " ".join(plain_words(bench[2][1])[:9])), (None, bench[1][1])]
    found = decontam.contained(frame(docs).withColumn("items", F.lit("clash")), frame(bench, "item_id long, text string"), block_windows=block_windows)
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"])) for r in found.collect()]
    assert sorted(got, key=repr) == expected(docs, bench)
    assert found.columns == ["doc_id", "text", "n_words", "spans", "items"]


def test_decontamination_of_nothing(frame):
    empty = frame([], "item_id long, text string")
    assert [tuple(r) for r in decontam.report(decontam.contained(frame(["a b"]), empty)).select("n_words", "n_hit", "contaminated").collect()] == [(2, 0, False)]
    assert decontam.contained(frame([]), frame(["a b"], "item_id long, text string")).count() == 0


def brute(docs):
    sets = []
    for _, t in docs:
        w = plain_words(t)
        n = min(5, len(w))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset())
    distinct = list(dict.fromkeys(sets))
    links = Counter()
    root = {s: s for s in distinct}

    def find(x):
        while root[x] is not x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(docs, sets, strict=True):
        if i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    return sorted(((i, least.get(find(s)), links[s], sets.count(s)) for (i, _), s in zip(docs, sets, strict=True)), key=repr)


def copies(rng):
    docs, n = [], 0
    for _ in range(12):
        base = sentence(rng, rng.choice([4, 30, 120]), 5000).split()
        for _ in range(rng.choice([1, 2, 7])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            docs.append((n, " ".join(w)))
            n += 1
    return docs + [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "One, TWO"), (n + 3, "One, TWO"), (None, docs[0][1]), (0, "another text for a known id")]


def test_similar(frame, monkeypatch):
    docs = copies(random.Random(3))
    got = sorted(map(tuple, jaccard.similar(frame(docs)).collect()), key=repr)
    assert got == brute(docs)


def test_similar_in_blocks(frame, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", 4)
    monkeypatch.setattr(jaccard, "VERIFY_BLOCK", 3)
    monkeypatch.setattr(jaccard, "SHARD_ROWS", 5)
    rng = random.Random(4)
    base = sentence(rng, 80, 5000).split()
    docs = [(i, " ".join([*base[:i], f"y{i}", *base[i + 1 :]])) for i in range(25)] + copies(rng)[:20]
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    assert sorted(map(tuple, jaccard.similar(frame(docs)).collect()), key=repr) == brute(docs)


def test_one_of_each_class_stays(frame):
    docs = copies(random.Random(6))
    kept = jaccard.representatives(frame(docs).withColumn("set", F.lit(1))).collect()
    classes = {(r[1], r[2] > 0) for r in brute(docs)}
    assert len(kept) >= len({c for c, _ in classes}) and kept[0].asDict().keys() == {"doc_id", "text", "set"}
    again = jaccard.similar(frame([(r.doc_id, r.text) for r in kept])).agg(F.sum("n_links").alias("l"), F.max("n_copies").alias("c")).first()
    assert (again.l, again.c) == (0, 1)


def test_null_and_repeated_ids_in_number(frame):
    rng = random.Random(7)
    texts = [sentence(rng, 40, 5000) for _ in range(30)]
    docs = [(None, t) for t in texts * 3] + [(7, t) for t in texts[:20]] + [(7, texts[0])] * 40 + [(9, texts[25])]
    assert sorted(map(tuple, jaccard.similar(frame(docs)).collect()), key=repr) == brute(docs)
    kept = Counter((r.doc_id, r.text) for r in jaccard.representatives(frame(docs)).collect())
    assert kept == Counter({(7 if i < 20 else 9 if i == 25 else None, t): 1 for i, t in enumerate(texts)})


@pytest.mark.parametrize("heavy", [2, 1000])
def test_components_with_hubs(spark, monkeypatch, heavy):
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    edges = [(0, i) for i in range(1, 60)] + [(999, i) for i in range(500, 560)] + [(999, 30)] + [(2000 + i, 2001 + i) for i in range(9)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(60), *range(500, 560), 999], 0), **dict.fromkeys(range(2000, 2010), 2000)}


def test_blocks_are_bounded_in_shingles(frame, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 400)
    rng = random.Random(8)
    base = sentence(rng, 150, 5000).split()
    docs = [(i, " ".join([*base[:i], f"y{i}", *base[i + 1 :]])) for i in range(20)]
    assert sorted(map(tuple, jaccard.similar(frame(docs)).collect()), key=repr) == brute(docs)


def test_no_documents(frame):
    assert jaccard.similar(frame([])).count() == 0 and jaccard.representatives(frame([])).count() == 0


def test_pruning_bound():
    least = jaccard.least_matches()
    assert len(least) == 8 and all(a < b for a, b in zip(least, least[1:], strict=False))
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, 128).astype(np.uint16)
    near, far = a.copy(), rng.integers(0, 1 << 16, 128).astype(np.uint16)
    near[rng.permutation(128)[:26]] ^= 1
    assert list(jaccard.survivors(a, np.stack([near, far, a]), least)) == [True, False, True]


def test_shared_counts_small_and_large():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(9)]
    left, right = np.arange(4), np.arange(4, 9)
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
    assert jaccard.shared_counts(sets, left, right).tolist() == want and jaccard.shared_counts(sets[:6], left, np.array([4, 5])).tolist() == [r[:2] for r in want]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 105), (105, 103), (7, 7), (200, 201), (200, 201)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 103: 100, 105: 100, 200: 200, 201: 200}
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0
