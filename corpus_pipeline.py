"""The corpus pipeline: five stages from raw documents to token ids.

STAGES lists (name, function).  Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm.bpe import encode_documents
from turnweave.llm.common import forget, materialize, table
from turnweave.llm.decontaminate import drop_leaks
from turnweave.llm.near_dup import near_duplicates
from turnweave.llm.substring import remove_repeats
from turnweave.llm.toxicity import THRESHOLD, keep_below, train_toxicity, training_fold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of the toxicity operator; null texts stay."""
    model = train_toxicity(docs, training_fold(table(spark, sf_dir, "labels")))
    return keep_below(docs, model, THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each group of near copies (five words, 0.8); a null doc_id stays."""
    kept = near_duplicates(docs, size=5, percent=80).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionAll(docs.where("doc_id is null"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; passages of 50 words or more that occur in an earlier document are cut out."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = remove_repeats(docs, carry=others)
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no benchmark item occurs within its budget of edits; null texts stay."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text decoded from them."""
    out = encode_documents(docs)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring", cut_repeated_passages),
    ("decontaminate", drop_benchmark_leaks),
    ("bpe", encode),
]

#: The stages are not expressible in SQL (a fitted score, byte-pair merges); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table is deleted when the next is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        after = materialize(stage(spark, docs, sf_dir))
        if k:
            forget(docs)
        docs = after
    return docs
