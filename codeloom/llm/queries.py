"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import docpairs, leakage, mixing, nearcopies, pieces, provenance, sentences, syntax
from codeloom.llm.sql import SQL  # noqa: F401
from codeloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = provenance.classify(table(spark, sf_dir, "source_files"))
    return judged.where("NOT hand_written").select("file_id").distinct()


def p1_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the classifier on repositories that it was not fitted on."""
    return provenance.train(table(spark, sf_dir, "source_files")).drop("weights")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = syntax.check_files(table(spark, sf_dir, "source_files").select("file_id", "relative_path", "content"))
    return checked.where("repair.edit_cost > 0").select("file_id").distinct()


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_rates(syntax.check_files(table(spark, sf_dir, "source_files")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = nearcopies.near_pairs(table(spark, sf_dir, "chunks"), "chunk_id", "source_text")
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.groups(table(spark, sf_dir, "chunks"), "chunk_id", "source_text").withColumnRenamed("id", "chunk_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = docpairs.extract(table(spark, sf_dir, "chunks")).where("doc.description IS NOT NULL")
    return described.select("chunk_id").distinct()


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.pairs(table(spark, sf_dir, "chunks")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces.split_cells(table(spark, sf_dir, "chunks"), "chunk_id", "source_text", "start_line", with_text=False)
    return cut.where("piece_no > 0").select("chunk_id").distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_cells(table(spark, sf_dir, "chunks"), "chunk_id", "source_text", "start_line")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.report(_leaks(spark, sf_dir))


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.decontaminate(table(spark, sf_dir, "documents"), _leaks(spark, sf_dir))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights")).copies


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights")).shares


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.boundaries(table(spark, sf_dir, "documents")).select("doc_id", "sent_end").distinct()


def p9_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_validation, p2_found, p2_rates, p4_found, p4_groups, p5_found, p5_pairs, p6_found, p6_pieces,
        p7_found, p7_report, p7_cleaned, p8_mix, p8_shares, p9_found, p9_sentences,
    )
}
