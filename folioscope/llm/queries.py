"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import ann, decontamination, language_id, lexical, line_dedup, packing, quality, simhash, token_counts, token_files, toxicity, vector_codes, warc
from folioscope.llm.common import held_out, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are null, zero or not finite take no part; ties go to the smaller id; repeated ids are searched each."""
    return ann.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a row, repeated rows too; null and empty html are empty payloads, equal ones revisit the smallest page_id."""
    folder = warc.write_warc(table(spark, sf_dir, "pages"), revisit_from=0)
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, repeated ones too; null texts and those without a letter are und; ties go to the first language."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(~held_out("doc_id")))
    return language_id.predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, repeated ones too; null and empty texts are scored as one empty line."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = quality.learn(docs, labels.where(~held_out("doc_id")))
    return quality.score(docs, field, threshold=0.7).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, repeated ones too; null and empty texts have no tokens; long texts are counted whole."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), limit=4096)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that leaks; repeated rows give one; null and empty texts and items give none."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, repeated ones too; null and empty texts have the end id alone; equal ids stand in the order of their texts' hash."""
    folder = token_files.write_token_files(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, folder)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, repeated ones too; null and empty texts stay as they are; the smallest doc_id keeps its lines."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_words=50)
    return out.select("doc_id", F.col("text").alias("kept_text"), "dropped_lines", "dropped_words")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, repeated ones too; texts without words have fingerprint zero and link like any other."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), size=4, distance=4)
    return groups.select("doc_id", simhash.hex_print("fp").alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a piece; null and empty texts have the end id alone; repeated rows are packed each; long texts are cut at 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=1, capacity=2048)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a kept vector, repeated ones too; null, empty and non-finite vectors are dropped; null labels are one label."""
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    summed = vector_codes.with_label_errors(coded)
    return summed.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, repeated ones too; null and empty texts are scored as texts without words."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.learn(docs, labels.where(~held_out("doc_id")))
    return toxicity.score(docs, machine, threshold=0.3).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and documents without terms (null, empty) give no rows; equal scores by ascending doc_id; repeated rows are ranked each."""
    index = lexical.build(table(spark, sf_dir, "documents"))
    return lexical.search(index, table(spark, sf_dir, "benchmark"), k=50)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of ``corpus_pipeline`` over all documents; nulls, empty and repeated rows go as each stage's docstring says."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ann, op2_warc, op3_language_id, op4_quality, op5_token_counts, op6_decontamination, op7_token_files, op8_line_dedup, op9_simhash, op10_packing, op11_vector_codes, op12_toxicity, op13_lexical, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.oracle(),
        "op8_line_dedup": line_dedup.oracle() + line_dedup.DIGEST_SQL.format(table="documents"),
        "op11_vector_codes": vector_codes.oracle(),
        "op13_lexical": lexical.ORACLE,
    }
