"""The term automaton against patterns, term by term."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodex.functions import automaton as A
from lodex.functions import text
from lodex.operators import rules
from lodex.sources import tables as T


def plain_places(terms, texts):
    """Each term by its own pattern, overlapping places too."""
    out = set()
    for k, t in enumerate(terms):
        p = re.compile(f"(?=({text.terms_pattern([t])}))") if not A.is_whole(t) else re.compile(rf"(?<![A-Za-z0-9_])(?={re.escape(t)}(?![A-Za-z0-9_]))")
        out |= {(i, m.start(), k) for i, s in enumerate(texts) for m in p.finditer(s)}
    return out


@pytest.mark.parametrize("cells", [0, 1 << 24])
def test_all_places(monkeypatch, cells):
    monkeypatch.setattr(A, "CELLS", cells)
    A.automaton.cache_clear()
    monkeypatch.setattr(A, "LANE", 7)
    monkeypatch.setattr(A, "BLOCK", 60)
    rng = random.Random(1)
    for trial in range(120):
        letters = "abé_ 女😀1"[: rng.randrange(2, 9)]
        word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(1, n)))
        terms = tuple({word(rng.choice([3, 6, 12])) for _ in range(rng.randrange(1, 25))})
        texts = [word(rng.choice([2, 40, 90])) if rng.random() < 0.9 else "" for _ in range(20)]
        a = A.automaton(terms)
        got = list(map(tuple, a.occurrences(texts).tolist()))
        assert len(got) == len(set(got)) and set(got) == plain_places(a.terms, texts), (trial, terms)


def test_first_place_is_the_patterns(monkeypatch):
    monkeypatch.setattr(A, "LANE", 9)
    rng = random.Random(2)
    for _ in range(60):
        word = lambda n: "".join(rng.choice("ab c") for _ in range(rng.randrange(1, n)))
        terms = tuple({word(8) for _ in range(12)})
        texts = [word(50) for _ in range(20)]
        a, pattern = A.automaton(terms), re.compile(text.terms_pattern(list(terms)))
        order = {t: i for i, t in enumerate(sorted(a.terms, key=lambda t: (A.is_whole(t), t)))}
        got = A.first_of(a.occurrences(texts), np.array([order[t] for t in a.terms]), len(texts))
        assert [a.terms[k] if k >= 0 else None for k in got] == [m and m.group() for m in map(pattern.search, texts)]


def test_no_terms_and_no_texts():
    assert len(A.automaton(()).occurrences(["abc", ""])) == 0 and len(A.automaton(("a",)).occurrences([])) == 0 and len(A.automaton(("", "")).occurrences(["x"])) == 0
    assert A.first_of(A.automaton(("a",)).occurrences(["b"]), np.array([0]), 1).tolist() == [-1]


def test_many_terms_cost_what_few_do(monkeypatch):
    """Steps, not seconds: the walk takes as many, with failure links no more than two edges are looked at for each character."""
    monkeypatch.setattr(A, "CELLS", 0)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(12))
    texts = [" ".join(word() for _ in range(60)) for _ in range(50)]
    steps, looked, search = {}, {}, np.searchsorted
    for n in (20, 10_000):
        a = A.automaton(tuple(word() for _ in range(n)))
        own = []
        monkeypatch.setattr(A.np, "searchsorted", lambda x, v, own=own: own.append(np.size(v)) or search(x, v))
        a.occurrences(texts)
        monkeypatch.setattr(A.np, "searchsorted", search)
        steps[n], looked[n] = sum(v == 1 for v in own), sum(own)
    assert looked[20] < looked[10_000] < 2.5 * sum(map(len, texts)) * (1 + 11 / 512)


def by_pattern(name, given):
    """The signal of a name by one pattern of all terms, as the rules define it."""
    plain = name.lower()
    for e in given.exceptions:
        plain = plain.replace(e, "")
    m = re.search(text.terms_pattern(list(given.terms)), plain)
    d = re.search(given.domain, plain)
    return f"term:{m.group()}" if m else f"domain:{d.group()}" if d else ""


def test_reasons_by_patterns(spark):
    rng = random.Random(4)
    words = ["av", "have", "avx", "longword", "longwords", "word", "x.xyz", "banner", "ok", "女優", "that", "that word", "AV"]
    given = rules.Rules(terms=("av", "longword", "word", "女優", "wordlong", "gword av"), name_terms=("banner", "av"), exceptions=("that word",), domain=r"[a-z]+\.xyz")
    name = lambda: rng.choice([" ", "", "-"]).join(rng.choice(words) for _ in range(rng.randrange(5)))
    rows = [(f"{i:04}", name() if i % 17 else None, 1, 1, [(name() if rng.random() < 0.9 else None, 1) for _ in range(rng.randrange(5))], i, 0, "") for i in range(300)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in T.LISTING.items()))
    for r in rules.with_reasons(table, given, tested=False).collect():
        own = by_pattern(r.name, given) if r.name is not None else ""
        banner = re.search(text.terms_pattern(list(given.name_terms)), r.name.lower()) if r.name is not None else None
        first = [f"name-{own}"] if own else [f"banner:{banner.group()}"] if banner else []
        assert r.reasons == first + [f"file-{h}" for f in r.files if f.path is not None and (h := by_pattern(f.path, given))], r
    got = {(r.info_hash, r.term) for r in rules.term_hits(table, given).collect()}
    want = {(h, t) for h, n, *_ in rows if n is not None for t in given.terms if re.search(text.terms_pattern([t]), n.lower().replace("that word", ""))}
    assert got == want
    assert rules.term_hits(table.limit(0), given).count() == 0 and rules.screened(table.limit(0), given).count() == 0


def test_long_term_lists_stay_out_of_the_plan(spark):
    table = spark.createDataFrame([("a", "x term00777 y", 1, 1, [("term00042", 1)], 1, 0, "")], ", ".join(f"{c} {k}" for c, k in T.LISTING.items()))
    given = rules.Rules(terms=tuple(f"term{i:05}" for i in range(50_000)))
    rows = rules.with_reasons(table, given, tested=False)
    assert rows.first().reasons == ["name-term:term00777", "file-term:term00042"]
    assert len(rows._jdf.queryExecution().executedPlan().toString()) < 20_000
    assert [r.term for r in rules.term_hits(table.withColumn("name", F.lit("term49999term00000")), given).collect()] in (["term00000", "term49999"], ["term49999", "term00000"])
