"""The corpus pipeline's stages, each against a plain version on its own input, and on odd tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lodex.llm import jaccard, packing, secret_scan, toxicity

from test_documents import BAD, SECRET, check_packing, distance, toxic_text
from test_pairs import brute, expected, plain_words, sentence

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with small tables: near and exact copies, toxic texts, benchmark passages, secrets, nulls and repeated rows."""
    out = tmp_path_factory.mktemp("tables")
    rng = random.Random(31)
    bench = [(i, sentence(rng, 25, 3000)) for i in range(6)] + [(6, None)]
    rows = [(i, toxic_text(rng, i % 5 == 0)) for i in range(200)]
    rows += [(200 + i, sentence(rng, 80, 3000)) for i in range(30)]
    rows += [(300 + i, rows[200 + i][1].replace("w1", "w1", 1) + " tail") for i in range(10)] + [(320 + i, rows[210 + i][1]) for i in range(5)]
    rows += [(400 + i, f"{sentence(rng, 20, 3000)} {bench[i][1]} {sentence(rng, 20, 3000)}") for i in range(6)]
    rows += [(500 + i, f"{sentence(rng, 30, 3000)} {SECRET} {sentence(rng, 3, 3000)}") for i in range(4)]
    rows += [(600, None), (601, ""), (602, " \n"), (603, "one two"), (604, "z" * 40_000), (605, sentence(rng, 9000, 3000)), (605, rows[205][1]), (None, rows[206][1]), (None, sentence(rng, 40, 3000)), rows[7], rows[7]]
    docs = [(i, t, "en", "web", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def rows_of(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def plain_toxicity(text, model):
    """By distances between all words and terms."""
    marked, total, terms, inside = toxicity.marked_words(text or ""), 0.0, set(), False
    for i, w in enumerate(marked):
        if w == toxicity.MARK:
            inside = not inside
            continue
        if w not in model.terms and w in model.clean:
            continue
        near = [(d, t) for t in model.terms if abs(len(t) - len(w)) <= 2 and (d := distance(w, t)) <= model.bounds[t]]
        if near:
            d, t = min(near)
            total += model.terms[t] * toxicity.context(marked, i, inside) * (toxicity.SPELLING if d else 1)
            terms.add(t)
    x = model.weights @ np.array([1, np.log1p(total), np.log1p(len(terms))])
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def plain_redacted(text):
    """Each run of overlapping spans as one mark."""
    merged = []
    for a, _, b, _ in secret_scan.scan_text(text or "")[1]:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in reversed(merged):
        text = text[:a] + "[SECRET]" + text[b:]
    return text, bool(merged)


def test_stages_against_plain_versions(spark, folder, tokenizer):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = rows_of(docs)

    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), keep=toxicity.train_fold())
    got = rows_of(pipeline.drop_toxic(spark, docs, folder))
    assert got == Counter({r: n for r, n in before.items() if plain_toxicity(r[1], model) < pipeline.TOXIC})
    assert set(BAD) <= set(model.terms) and not any(r[0] is not None and r[0] < 200 and r[0] % 5 == 0 for r in got)
    assert {r for r in before if r[0] is None or r[0] >= 200 or r[0] % 5} == set(got)  # clean ones stay

    docs = spark.createDataFrame(list(got.elements()), DOCS)
    kept = rows_of(pipeline.drop_near_copies(spark, docs, folder))
    given = [(r[0], r[1]) for r in got.elements()]
    classes = {}
    for i, t in given:
        classes.setdefault(t, i)
    by_class = Counter((r[1], r[2] > 0) for r in brute(given))
    assert set(kept) <= set(got) and max(kept.values()) == 1
    assert jaccard.similar(docs).select("class_id").distinct().count() <= sum(kept.values())
    left = brute([(r[0], r[1]) for r in kept.elements()])
    assert all(links == 0 and copies == 1 for _, _, links, copies in left)
    assert {c for c, _ in by_class if c is not None} == {c for _, c, _, _ in left if c is not None}  # the least id of each class stays

    docs = spark.createDataFrame(list(kept.elements()), DOCS)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = rows_of(pipeline.drop_contaminated(spark, docs, folder))
    hit = {(i, n) for i, n, k, _ in expected([(r[0], r[1]) for r in kept], bench) if k}
    assert clean == Counter({r: n for r, n in kept.items() if (r[0], len(plain_words(r[1]))) not in hit}) and len(hit) == 6

    docs = spark.createDataFrame(list(clean.elements()), DOCS)
    redacted = rows_of(pipeline.redact_secrets(spark, docs, folder))
    want = Counter()
    for (i, t, lang, source, n), k in clean.items():
        text, changed = plain_redacted(t)
        want[i, text, lang, source, len(text) if changed else n] += k
    assert redacted == want and sum("[SECRET]" in (r[1] or "") for r in redacted) == 4

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    packed = pipeline.pack_sequences(spark, spark.createDataFrame(list(redacted.elements()), DOCS), folder).collect()
    check_packing(packed, 4096)
    pieces = Counter()
    for r in redacted.elements():
        ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        pieces.update((r[0], k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces


def test_run_is_the_stages_in_a_row(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    stay = Counter(r.doc_id for r in docs.select("doc_id").collect())
    got = pipeline.run(spark, folder)
    assert Counter(r.doc_id for r in got.where("piece = 0").collect()) == stay and check_packing(got.collect(), 4096)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]


CLASHES = ("toxicity", "n_words", "Spans", "items", "base", "CUT", "set", "node", "_row", "_rest", "row", "id", "label", "sequence_id")


@pytest.mark.parametrize("at", range(5))
def test_stages_on_clashing_columns_and_empty_tables(spark, folder, at):
    name, stage = pipeline.STAGES[at]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id >= 196 and doc_id < 215 or doc_id > 399 or doc_id is null")
    wide = docs.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in CLASHES})
    plain, got = stage(spark, docs, folder), stage(spark, wide, folder)
    if at < 4:
        assert got.columns == wide.columns and [f.dataType for f in plain.schema.fields] == [f.dataType for f in docs.schema.fields]
        assert rows_of(got) == rows_of(plain)
        assert got.where(" or ".join(f"`{c}` <> concat('{c} ', cast(doc_id as string))" for c in CLASHES)).count() == 0
    else:
        key = lambda df: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
        assert key(got) == key(plain)
        assert packing.certificate(plain).first().sequences == len({r.sequence_id for r in plain.collect()})
    assert stage(spark, docs.where("false"), folder).count() == 0
    nulls = docs.select("doc_id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields[1:]))
    assert stage(spark, nulls, folder).count() == (1 if at == 1 else docs.count())
