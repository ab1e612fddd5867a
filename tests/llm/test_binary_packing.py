"""Packing by powers of two: exact round trips, the tokenizer's ids, and batches."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodex.llm import binary_packing as packing

ODD = [None, "", " \n", "x", "z" * 30_000, "Straße Ünï 日本 😀", "x", "same text again", "same text again"]


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_pieces_are_the_binary_digits_of_the_tokenizers_ids(frame, path):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    alphabet = "aB é'É.,!²½ßÑ_-́ \t\n\x1c\x85\xa0　İΣς日3x9'sre'llﬁ한ǅªºµ😀"
    texts = [*ODD, "don't <|endoftext|> it's", "a<|endoftext|>b", "日本 a  b 日本 ", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(90))) for _ in range(600)), " ".join(f"word{rng.randrange(99)}," for _ in range(3000))]
    plain, got = Tokenizer.from_file(path), {}
    rows = frame(texts).withColumn("sequence_id", F.lit("clash")).withColumn("Length", F.lit(None))
    for r in packing.sequences(packing.decompose(rows, path, most=16)).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids, own = [*plain.encode(t or "", add_special_tokens=False).ids, 1], got[i]
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == ids, repr(t)
        lengths = [r.length for r in own]
        assert [r.start for r in own] == [sum(lengths[:k]) for k in range(len(own))] and sorted(lengths, reverse=True) == lengths
        assert all(r.length == 1 << r.bucket <= 16 and r.offset == 0 and r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(ids) for r in own)
        assert lengths.count(16) == len(ids) // 16 and len(set(lengths) - {16}) == len(lengths) - lengths.count(16) == (len(ids) % 16).bit_count()
    every = [r for own in got.values() for r in own]
    assert len({r.sequence_id for r in every}) == len(every)
    order = sorted(every, key=lambda r: r.sequence_id)
    assert [r.bucket for r in order] == sorted(r.bucket for r in every)


def test_ids_of_single_characters(path):
    ids = packing.ByteIds(path)
    assert ids.ranked is not None
    for at in range(0, 0x3100, 16):
        t = "".join(f"a{c} {c}b 1{c}2 {c}. \n{c}" for c in map(chr, range(at, at + 16)))
        assert np.frombuffer(ids.of(t), "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids


def test_other_vocabularies_go_to_the_tokenizer(tokenizer):
    ids = packing.ByteIds(tokenizer)
    assert ids.ranked is None and np.frombuffer(ids.of("Hi there"), "<u4").tolist() == ids.tokenizer.encode("Hi there", add_special_tokens=False).ids


def test_batches_hold_equal_lengths(spark, frame, path):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(200))) for _ in range(120)]
    packed = packing.sequences(packing.decompose(frame(texts), path, most=64, with_ids=False).withColumn("batch", F.lit("clash")))
    rows = packing.batches(packed, tokens=128, seed=3).collect()
    assert sorted(r.sequence_id for r in rows) == sorted(r.sequence_id for r in packed.collect())
    seen = {}
    for r in rows:
        seen.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, _), own in seen.items():
        assert sorted(r.place for r in own) == list(range(len(own))) and sum(r.length for r in own) <= 128 and {r.length for r in own} == {1 << bucket}
    for bucket in {b for b, _ in seen}:
        n = sorted(k for b, k in seen if b == bucket)
        assert n == list(range(len(n))) and all(sum(r.length for r in seen[bucket, k]) == 128 for k in n[:-1])
    other = packing.batches(packed, tokens=128, seed=4).collect()
    assert {(r.sequence_id, r.batch) for r in rows} != {(r.sequence_id, r.batch) for r in other}
    out = packing.write_buckets(packed)
    assert spark.read.parquet(out).where("bucket = 3").select("sequence_id").count() == sum(r.bucket == 3 for r in rows)


def test_nothing_and_wrong_lengths(frame, path):
    none = packing.decompose(frame([]), path)
    assert none.count() == 0 and packing.sequences(none).count() == 0 and packing.batches(packing.sequences(none)).count() == 0
    assert [r.length for r in packing.decompose(frame([(None, None), (None, "x")]), path).collect()] == [1, 2]
    with pytest.raises(ValueError, match="power"):
        packing.decompose(frame([]), path, most=100)


def test_blocks():
    assert list(packing.blocks([], 5)) == [] and list(packing.blocks(["aaa", "bb", "c", "d" * 9, ""], 5)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
