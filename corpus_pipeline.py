"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread.

Toxic documents go, one document of each group of near duplicates stays, secrets are cut
out of what is left, sources are mixed to their target weights, and the mix is packed into
token sequences. Every stage works on all rows that the one before it returns, and all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluxmere.llm import common, mixing, near_dedup, packing, secret_ledger, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7.

    Null texts are empty and score as texts without evidence; repeated rows stay or go
    together; an empty table gives no rows, and without labels of both classes all stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 85 %, the one of the least doc_id.

    Texts without words and rows with null ids stay; rows equal in id and text stay once, rows
    that repeat an id with another text go by their own text; no rows of none."""
    return near_dedup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced; null and empty texts, repeated rows and all other
    columns stay as they are, ``n_chars`` follows."""
    return secret_ledger.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents, parts of them and up to three copies, as their blocks were taken.

    Null sources are a source; null and empty texts leave; repeated rows each have their own
    place, ties by doc_id and size; no rows of none."""
    return mixing.mix_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of at most 2048 ids.

    A null or empty text is one end id; repeated rows are packed each; no rows of none."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix_sources), ("packing", pack_tokens)]
#: Models and tokens are beyond SQL; tests/llm holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
