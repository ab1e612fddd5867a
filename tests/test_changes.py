"""One table of changes: folds against a plain replay, and jobs stopped at every write."""

import json
import random

import pytest

from lodex.operators import changes
from lodex.sources import tables as T

SCHEMA = ", ".join(f"{c} {k}" for c, k in T.LISTING.items())


def table(spark, n):
    return spark.createDataFrame([(f"k{i:03}", f"raw name {i} extra", 1, 1, [], 100 + i, 0, "") for i in range(n)], SCHEMA)


def old(spark):
    return spark.createDataFrame([("k000", "old", "", 5), ("zz", "old", "", 5)], "info_hash string, reason string, name string, created_at long")


def answer(spark, rows, size=100):
    """Replies about the unreviewed keys in order: adult, spam, a trim or nothing by number."""
    items = [{"i": i % size + 1, **verdict(h)} for i, h in enumerate(rows)]
    return spark.createDataFrame([(b, json.dumps(items[b * size : (b + 1) * size])) for b in range(-(-len(items) // size))] or [(0, "[]")], "batch_id long, content string")


def verdict(h):
    n = int(h[1:])
    return {"label": "adult"} if n % 7 == 0 else {"label": "spam"} if n % 5 == 0 else {"label": "ok", "clean": f"raw name {n}"} if n % 2 else {"label": "ok"}


def state(spark, path, before=None):
    plain = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    return tuple(plain(f(spark, path, before)) for f in (changes.listings, changes.blocked, changes.audit))


def replay(n, runs):
    """What the tables are after runs (number, dry, most), each over the oldest unreviewed keys."""
    rows = {f"k{i:03}": [0, ""] for i in range(n)}
    blocked, audit = {"k000": ("old", "", 5), "zz": ("old", "", 5)}, []
    for run, dry, most in runs:
        for h in [h for h in rows if rows[h][0] == 0][:most]:
            v, title = verdict(h), f"raw name {int(h[1:])} extra"
            rows[h][0] = run * 1000
            if v["label"] != "ok" or v.get("clean"):
                audit.append((v["label"] if v["label"] != "ok" else "trim", h, title, v.get("clean", ""), dry, run))
            if not dry and v.get("clean"):
                rows[h][1] = v["clean"]
            if not dry and v["label"] != "ok":
                del rows[h]
                blocked.setdefault(h, (v["label"], title, run * 1000))
    listing = [(h, f"raw name {int(h[1:])} extra", 1, 1, [], 100 + int(h[1:]), at, clean) for h, (at, clean) in rows.items()]
    plain = lambda found: sorted(tuple(map(str, r)) for r in found)
    return plain(listing), plain((h, *v) for h, v in blocked.items()), plain(audit)


def run(spark, path, number, dry, most):
    rows = [r.info_hash for r in changes.listings(spark, path, number).where("reviewed_at = 0").orderBy("created_at", "info_hash").limit(most).collect()]
    changes.review_run(spark, path, answer(spark, rows), number, number * 1000, most, dry)


def test_folds_equal_a_replay(spark, tmp_path):
    path, done = str(tmp_path), []
    changes.start(table(spark, 60), old(spark), path)
    assert state(spark, path) == replay(60, [])
    for number, dry in ((1, False), (2, True), (3, False)):
        run(spark, path, number, dry, 20)
        done.append((number, dry, 20))
        if number == 2:
            run(spark, path, number, dry, 20)  # again
            assert changes.compact(spark, path) == 2 and changes.compact(spark, path) == 2
        assert state(spark, path) == replay(60, done)
    assert state(spark, path, 3) == replay(60, done[:2])
    run(spark, path, 4, False, 20)  # nothing is left
    assert state(spark, path) == replay(60, done)
    with pytest.raises(ValueError):
        changes.review_run(spark, path, answer(spark, []), 0, 1)
    with pytest.raises(ValueError):
        changes.listings(spark, f"{path}/none")


def test_a_job_stopped_at_any_write(spark, tmp_path, monkeypatch):
    """Before each write, and after its files but before its _SUCCESS file, the tables are as before the job."""
    path, write = str(tmp_path), changes._write
    changes.start(table(spark, 30), old(spark), path)
    run(spark, path, 1, False, 10)
    want = state(spark, path)
    assert want == replay(30, [(1, False, 10)])
    rng = random.Random(1)
    for job, writes in ((lambda: run(spark, path, 2, False, 10), 1), (lambda: changes.compact(spark, path), 3)):
        for k in range(writes):
            for partly in (False, True):
                seen = [0]

                def stopped(rows, out, seen=seen, k=k, partly=partly):
                    seen[0] += 1
                    if seen[0] <= k:
                        return write(rows, out)
                    if partly:
                        write(rows.sample(rng.random(), 1), out)
                        (tmp_path / out.removeprefix(f"{path}/") / "_SUCCESS").unlink()
                    raise RuntimeError("stopped")

                monkeypatch.setattr(changes, "_write", stopped)
                with pytest.raises(RuntimeError, match="stopped"):
                    job()
                monkeypatch.setattr(changes, "_write", write)
                assert state(spark, path) == want
    run(spark, path, 2, False, 10)
    changes.compact(spark, path)
    assert state(spark, path) == replay(30, [(1, False, 10), (2, False, 10)])
