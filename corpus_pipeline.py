"""Cleaning a corpus of documents in five stages; counts as part of the subpackage llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept. All but the last return the columns of documents: doc_id, text, lang, source,
n_chars. Between stages the rows are written as Parquet and read again.

In every stage repeated rows keep a row each, or go together; null doc_ids and very long
texts are treated as any other; further columns, of any name, are left out; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latchwork.llm import decontam, minhash, pieces, pii, toxicity
from latchwork.llm.common import pick, settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the cut; the classifier learns from the labels that aren't held out.

    Null and empty texts have no words and stay.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_rows(pick(docs, *COLUMNS), model).where(F.col("score") < toxicity.CUT).drop("score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by five-word shingles at a similarity of 0.8.

    Documents without words link with nothing and stay; so do repeated rows of the same doc_id.
    """
    kept = minhash.near_duplicates(docs, words=5, percent=80).where("kept").select(F.coalesce("doc_id", F.lit(minhash.NO_ID)).alias("id")).distinct()
    rows = pick(docs, *COLUMNS)
    return rows.withColumn("id", F.coalesce("doc_id", F.lit(minhash.NO_ID))).join(kept, "id", "left_semi").drop("id")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark; null texts hold none and stay."""
    return decontam.keep_clean(pick(docs, *COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind; n_chars follows. Null texts stay null."""
    return pii.redact_rows(pick(docs, *COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document; the ids decode to its text. Null and empty texts have no ids."""
    coded = pieces.encode_texts(docs)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.translate("text", pieces.SPACE, " ")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("sentencepiece", encode),
]

#: SQL can't express the classifiers or the encoding; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
