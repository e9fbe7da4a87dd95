"""A training-data pipeline over documents: five stages, each one operator of palimpsest.llm.

Toxic documents go, repeated lines go, one document of each near-duplicate group
stays, repeated passages go, and what is left is packed into sequences. Each stage
works on all rows that the stage before it kept; in between they are written as Parquet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.line_dedup import drop_repeated_lines
from palimpsest.llm.near_dedup import near_duplicates
from palimpsest.llm.packing import pack_documents
from palimpsest.llm.suffix_dedup import remove_repeats
from palimpsest.llm.textblocks import released, remove_folder, shared_folder, tokenizer_file, with_sources
from palimpsest.llm.toxicity import fit_grammar, score_toxicity

#: Documents with this score or more are rejected.
TOXIC = 0.5
#: Documents are near copies from this similarity on, in percent; a pair at exactly that shares no table with probability 8.7e-5.
NEAR_PERCENT = 80
NEAR_HALF_KEYS = 14
CARRIED = ("lang", "source")


def _documents(df: DataFrame, text: str) -> DataFrame:
    """The columns of documents with the text a stage has left."""
    return df.select("doc_id", F.col(text).alias("text"), *CARRIED, F.length(text).cast("long").alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, fitted on this stage's labelled documents, doesn't reject."""
    grammar = fit_grammar(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, grammar, ("text", *CARRIED, "n_chars"))
    return scored.where(F.col("score") < TOXIC).select("doc_id", "text", *CARRIED, F.col("n_chars").cast("long").alias("n_chars"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them."""
    left = drop_repeated_lines(docs, keep=CARRIED)
    return with_sources(_documents(left, "kept"), left)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least doc_id."""
    grouped = near_duplicates(docs, percent=NEAR_PERCENT, half_keys=NEAR_HALF_KEYS)
    gone = grouped.where("not kept").select("doc_id")
    return with_sources(docs.join(gone, "doc_id", "left_anti").select("doc_id", "text", *CARRIED, F.col("n_chars").cast("long").alias("n_chars")), grouped)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated windows go; a character that is cut goes with them."""
    left = remove_repeats(docs, keep=CARRIED)
    return with_sources(_documents(left, "kept_text"), left)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token sequences."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_passages),
    ("packing", pack),
]

#: SQL can express neither the learned grammar nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each one's rows are written to the shared folder and read again.

    A stage's rows are deleted once the next one's are there, all of them where a stage fails; those that the result
    is made from stay, as it is computed when the caller wants it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    try:
        for name, stage in STAGES[:-1]:
            with released():
                stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                remove_folder(spark, f"{folder}/{before}")
            before = name
    except BaseException:
        remove_folder(spark, folder)
        raise
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
