"""The queries of the pipeline operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, langid, line_dedup, mixing, ngram_join, packing, permutation_index, quality, secrets, toxicity
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.judge(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).drop("text")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There is no audio among the tables: the vectors are rendered as recordings first. Alignments, and a row for each recording with its class."""
    return audio.align_and_name(audio.render(table(spark, sf_dir, "embeddings")), "id", "media")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the SQL, range-sorted by the position of a document's first turn; documents that are never taken come last."""
    rows = mixing.by_first_turn(mixing.mix_sources(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op10_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positions that op10_mixing sorts by: a row for each turn of a document, range-sorted. Beyond SQL's columns, so a query of its own."""
    return mixing.turns(mixing.mix_sources(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_neighbours": op5_neighbours,
    "op6_langid": op6_langid,
    "op7_audio": op7_audio,
    "op8_secrets": op8_secrets,
    "op9_ngram_join": op9_ngram_join,
    "op10_mixing": op10_mixing,
    "op10_turns": op10_turns,
}

ORACLES = {"op2_line_dedup": line_dedup.ORACLE, "op8_secrets": secrets.ORACLE, "op10_mixing": mixing.ORACLE}
