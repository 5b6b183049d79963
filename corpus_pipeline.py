"""From raw documents to token ids: toxicity, near copies, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs` and returns a DataFrame; all but the last return the columns
of documents. Rows with a null or empty text pass the filters (of toxicity, as long as the overall share of toxic examples, calibrated, is below
its threshold); rows that share a doc_id are kept or dropped together by near_dedup. Stages say how they treat nulls and repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfacts.llm import bpe, decontaminate, near_dedup, secret_scan, toxicity
from fleetfacts.llm.common import cut_lineage, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_REST = COLUMNS[2:]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; learnt from the labelled rows of documents."""
    labelled = read_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    scored = toxicity.score_toxicity(docs, labelled, labels, keep=_REST)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    found = near_dedup.near_duplicates(docs)
    # Null ids match nothing here, so their rows stay.
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    benchmark = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate.find_contamination(docs, benchmark, keep=_REST)
    return found.where(F.size("items") == 0).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by [SECRET] and n_chars counted anew where there were any."""
    found = secret_scan.find_secrets(docs, keep=_REST, mask="[SECRET]")
    return found.select(
        "doc_id", F.col("clean").alias("text"), "lang", "source",
        F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to."""
    return bpe.encode_documents(docs, *bpe.tokenizer_files())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode_tokens),
]

# Signatures, nearest examples and BPE merges are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
