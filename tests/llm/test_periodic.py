"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodex.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n", "x", "z" * 30_000, "Straße Ünï 日本 😀", "x", "a a a a a a", "a a a a a a", "same same same same same", "a a a a a a a a a a a a"]


def plain_runs(w):
    """All runs: for each period the maximal stretches, if no smaller period divides them."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(rng, n):
    for _ in range(n):
        kind = rng.randrange(4)
        if kind == 0:
            yield [rng.choice("ab") for _ in range(rng.randrange(60))]
        elif kind == 1:  # runs of runs
            unit = [rng.choice("ab") for _ in range(rng.randrange(1, 5))] * rng.randrange(1, 9) + ["c"] * rng.randrange(3)
            yield unit * rng.randrange(1, 7) + [rng.choice("abc") for _ in range(rng.randrange(9))]
        elif kind == 2:
            unit = [rng.choice("abcdef") for _ in range(rng.randrange(1, 30))]
            yield [rng.choice("abc") for _ in range(rng.randrange(20))] + (unit * 9)[: rng.randrange(1, 9 * len(unit))] + [rng.choice("abc") for _ in range(rng.randrange(20))]
        else:  # Fibonacci words hold many repeats
            a, b = "a", "ab"
            for _ in range(rng.randrange(9)):
                a, b = b, b + a
            yield list(b[: rng.randrange(1, 120)])


def test_runs_of_many_texts_at_once():
    rng = random.Random(1)
    rows = list(sequences(rng, 1500))
    for at in range(0, len(rows), 50):
        part = rows[at : at + 50]
        words = np.array([ord(c) for w in part for c in w])
        text = np.repeat(np.arange(len(part)), [len(w) for w in part])
        starts = np.cumsum([0, *(len(w) for w in part)])
        want = [(starts[i] + a, n, q) for i, w in enumerate(part) for a, n, q in plain_runs(w)]
        assert list(map(tuple, periodic.runs_of(words, text).tolist())) == want
    assert sum(len(plain_runs(w)) for w in rows) > 1000


def expected(i, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(i).encode() if i is not None else b"")
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    rs = plain_runs(w)
    best = min(rs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if rs else None
    gone = {k for a, m, q in rs for k in range(a + q, a + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(rs), *told, sha("".join("%d,%d,%d\n" % r for r in rs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_query_against_brute_force(frame, monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK_WORDS", 300)
    rng = random.Random(2)
    rows = [(i, " \t\n\x0b\x1c"[rng.randrange(3)].join(w)) for i, w in enumerate(sequences(rng, 300))]
    rows += [(1000 + i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 300)))) for i in range(200)]
    rows += [(2000 + i, t) for i, t in enumerate(ODD)] + [(10_000 + k, "a b c d e f g h i j k l") for k in range(60)] + [(-7, "x y z"), (None, "p q r s " * 9), (5, "a a a a a a a")]
    got = sorted(map(tuple, periodic.report(periodic.planted(frame(rows).withColumn("N_runs", F.lit(0)))).collect()), key=repr)
    assert got == sorted((expected(i, t) for i, t in rows), key=repr)


def test_runs_keep_other_columns(frame):
    rows = frame([(1, "a b a b a b a b c"), (2, None)]).withColumn("Runs", F.lit("clash")).withColumn("other", F.lit(None).cast("int"))
    one, two = periodic.runs(rows).orderBy("doc_id").collect()
    assert one.runs == [(0, 8, 2)] and one.collapsed == "a b c" and one.n_words == 9 and one.other is None and one.text == "a b a b a b a b c"
    assert two.runs == [] and two.collapsed == "" and two.n_words == 0
    assert periodic.runs(frame([])).count() == 0 and periodic.report(frame([])).count() == 0
    assert periodic.report(frame([("x", "a " * 6)], "doc_id string, text string")).first().length == 6


def test_a_long_text(frame):
    text = " ".join(f"w{i % 5000}" for i in range(200_000)) + " " + " ".join(f"v{i}" for i in range(1000)) + " z" * 5000
    got = periodic.report(frame([(1, text)])).first()
    assert got.n_runs == 2 and (got.start, got.length, got.period) == (201_000, 5000, 1)
    assert periodic.runs(frame([(1, text)])).first().runs[0] == (0, 200_000, 5000)


def test_nested_runs():
    w = ("a a a a a a b " * 5).split()
    assert plain_runs(w) == [tuple(r) for r in periodic.runs_of(np.array([ord(c) for c in w]), np.zeros(len(w), int)).tolist()]


@pytest.mark.parametrize("counts", [[], [5], [1, 2, 3], [0, 0], [400_000, 1]])
def test_blocks(counts):
    got = list(periodic.word_blocks(counts))
    assert [x for a, b in got for x in range(a, b)] == list(range(len(counts)))
