"""From raw documents to packed training sequences, stage by stage.

Every stage works on all that the one before it kept; all but the last return the columns of
documents. ``run`` writes each stage's rows to the shared folder and reads them again, so a lost
executor costs one stage at most; a stage's folder goes once the next is written.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import line_dedup, mixing, ngram_join, packing, toxicity
from gneiss.llm.common import cut, remove, row_print, shared_path, table
from gneiss.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain calls toxic go; it learns from labelled rows of these documents."""
    chain = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.judge(docs, chain).filter(~F.col("is_toxic")).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the one with the smallest id. No document goes; n_chars follows the text."""
    rows = line_dedup.line_dedup(docs)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return rows.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; documents without words and null ids stay."""
    found = ngram_join.ngram_join(docs)
    keep = cut(found.filter("component_id = doc_id").groupBy(F.col("doc_id").alias("__kept")).agg(F.count("*").alias("__rows")))
    kept = docs.join(keep.select("__kept").hint("shuffle_hash"), docs.doc_id == F.col("__kept"), "left_semi")
    if not (again := keep.filter("__rows > 1").select("__kept")).isEmpty():  # rows that repeat an id are one document: that with the least fingerprint
        repeated = kept.join(again, kept.doc_id == again["__kept"], "left_semi")
        least = repeated.groupBy(F.col("doc_id").alias("__kept")).agg(F.min(row_print(docs)).alias("__least"))
        repeated = repeated.join(least, (F.col("doc_id") == F.col("__kept")) & (row_print(docs) == F.col("__least")), "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(again, kept.doc_id == again["__kept"], "left_anti").unionByName(repeated)
    return kept.union(docs.filter("doc_id IS NULL"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, in order of training position."""
    return mixing.in_training_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces placed in sequences, along the order in which the stage before wrote its rows.

    The columns of documents hold no position, but files and their rows are in order of it. Rows
    that come from no file have no order.
    """
    try:
        place = packing.stored_place(docs)
    except AnalysisException:
        place = None
    return packing.pack(docs, tokenizer_path(), place=place)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_join", drop_near_duplicates), ("mixing", mix), ("packing", pack)]

#: A trained classifier and a tokenizer are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := shared_path(spark, f"pipeline-{name}"))
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
