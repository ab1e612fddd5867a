import pytest


@pytest.fixture
def frame(spark):
    """Documents (doc_id, text) from a list of texts or of (id, text)."""

    def make(rows, schema="doc_id long, text string"):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
