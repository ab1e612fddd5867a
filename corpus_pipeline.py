"""From raw documents to packed training sequences, each stage one operator over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodex.llm import decontam, jaccard, packing, secret_scan, toxicity
from lodex.llm.common import stored, table

#: Documents with this toxicity or more go.
TOXIC = 0.7

# In all stages: null texts are as empty ones, repeated rows are rows of their own (but for near copies, of which one
# stays), an empty table gives an empty result, and further columns, whatever their names, come through as they are.


def apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one, so that none clashes with what an operator adds."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *(F.col(c).alias(f"c_{c}") for c in docs.columns)).dropFields("c_doc_id", "c_text").alias("_rest"))


def together(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` again."""
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col("_rest")[f"c_{c}"].alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score less than TOXIC, by a model of the labels that may be learned from."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), keep=toxicity.train_fold())
    return together(toxicity.score(apart(docs), model).where(F.col("toxicity") < TOXIC), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of equal or similar ones; texts without words are equal."""
    return jaccard.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    found = decontam.contained(apart(docs), table(spark, sf_dir, "benchmark"))
    return together(found.where(F.size("spans") == 0), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret (or what encodes one) replaced by a mark; n_chars as the text is then."""
    found = secret_scan.redact(secret_scan.scan(apart(docs), keep_text=True), "text")
    n_chars = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_rest.c_n_chars"))
    return together(found.withColumn("_rest", F.col("_rest").withField("c_n_chars", n_chars)), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their sequences and places there; other columns end here."""
    import public_tokenizers

    return packing.pack_pieces(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False))


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_contaminated), ("secret scans", redact_secrets), ("best-fit packing", pack_sequences)]

#: Minhash, learned scores and tokenizers can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
