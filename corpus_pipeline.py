"""The corpus pipeline: documents to packed training sequences, in five stages.

Every stage works on all documents that the one before kept; its result is written as Parquet and
read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontamination, line_dedup, near_dups, packing, quality
from folioscope.llm.common import free_names, fresh_folder, held_out, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.7; the classifier learns from labels that aren't held out.

    Null and empty texts are scored as one empty line and stay or go by that.
    """
    labels = table(spark, sf_dir, "labels")
    field = quality.learn(docs, labels.where(~held_out("doc_id")))
    return quality.keep_good(docs, field, threshold=0.7)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of 50 words and more that stood before.

    n_chars follows the text. A document that loses all its words goes; one that had none stays.
    Columns of any name come through as they are.
    """
    lines, words = free_names(docs, 2)
    left = line_dedup.dedup_lines(docs, min_words=50, names=(lines, words))
    kept = left.where(~((F.col(lines) > 0) & F.col("text").rlike(r"^\s*$")))
    return _with_length(kept.select(*docs.columns), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of near duplicates (five words, 0.8).

    Texts without words (null, empty, blank) are copies of one another; of repeated rows one stays.
    """
    return near_dups.keep_one(docs, similarity=0.8, size=5)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item: null and empty texts stay, repeated rows are judged alike, long texts whole."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, packed into sequences of 2048.

    Null and empty texts are one piece with the end id; repeated rows are packed each; long texts are cut.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, capacity=2048)


def _with_length(rows: DataFrame, like: DataFrame) -> DataFrame:
    """n_chars of the new text, in the column's own type."""
    if "n_chars" not in like.columns:
        return rows
    return rows.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", fresh_lines),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", clean_of_benchmark),
    ("packing", packed),
]

#: No SQL: the classifier, the tokenizer and the packing order can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_folder(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
