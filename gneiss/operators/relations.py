"""Likely relationships between columns, from their profiles; and the exact overlap of value sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions import types as ty

POTENTIAL_SIMILARITY, NAME_SIMILARITY, DICTIONARY_MOST = 0.45, 0.20, 100
_EMPTY = (1 << 63) - 1
KINDS = ("SHARED_DICTIONARY", "SAME_VALUE_DOMAIN", "POTENTIAL_RELATION")


def min_hash_similarity(a: Column, b: Column) -> Column:
    """Equal bins as a share of bins that are not empty in both; 0 without any."""
    pairs = F.filter(F.slice(F.arrays_zip(a.alias("x"), b.alias("y")), 1, F.least(F.size(a), F.size(b))), lambda p: ~((p["x"] == _EMPTY) & (p["y"] == _EMPTY)))
    same = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
    return F.when(F.size(pairs) <= 0, F.lit(0.0)).otherwise(same / F.size(pairs))


def _eligible(profiles: DataFrame) -> DataFrame:
    return profiles.filter(~F.col("lob_content_skipped") & ~F.col("family").isin(ty.LOB, ty.BINARY) & (F.col("fingerprint.distinct_count") > 0))


def relationships(left: DataFrame, right: DataFrame, threshold: float = POTENTIAL_SIMILARITY) -> DataFrame:
    """kind, left_ref, right_ref, similarity, name_similarity, reason, ordered by kind and similarity.

    Both are profiles with schema_name and table_name and with fingerprints. Sides have a row per
    column of one table, so the theta join pairs columns, never rows of data.
    """
    a, b = _eligible(left).alias("a"), _eligible(right).alias("b")
    fa, fb = F.col("a.fingerprint"), F.col("b.fingerprint")
    rows = a.join(b, (F.col("a.family") == F.col("b.family")) | (F.col("a.family") == ty.OTHER) | (F.col("b.family") == ty.OTHER))
    same = F.lit(True)
    for part in ("distinct_count", "hash_sum", "hash_xor", "second_hash_sum"):
        same = same & (fa[part] == fb[part])
    similarity = min_hash_similarity(fa["min_hash_bins"], fb["min_hash_bins"])
    named = names.name_similarity(F.col("a.name"), F.col("b.name"))
    kind = F.when(same & (fa["distinct_count"] <= DICTIONARY_MOST), KINDS[0]).when(same, KINDS[1]).when((similarity >= threshold) & (named >= NAME_SIMILARITY), KINDS[2])
    rows = rows.select(
        kind.alias("kind"), names.reference(F.col("a.schema_name"), F.col("a.table_name"), F.col("a.name")).alias("left_ref"), names.reference(F.col("b.schema_name"), F.col("b.table_name"), F.col("b.name")).alias("right_ref"),
        F.when(same, 1.0).otherwise(similarity).alias("similarity"), named.alias("name_similarity"),
        F.when(same, "equal count and equal sums of independent hashes of the distinct values").otherwise("compatible types, similar names and overlapping distinct values by estimate").alias("reason"),
    ).filter("kind IS NOT NULL")
    rank = F.when(F.col("kind") == KINDS[0], 0).when(F.col("kind") == KINDS[1], 1).otherwise(2)
    return rows.orderBy(rank, F.desc("similarity"), "left_ref", "right_ref")


def set_overlap(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> DataFrame:
    """left_distinct, right_distinct, shared, jaccard of two columns' value sets, exactly; an equi-join of distinct values."""
    a = left.select(F.col(left_column).cast("string").alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.lit(1).alias("l"))
    b = right.select(F.col(right_column).cast("string").alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.lit(1).alias("r"))
    both = a.join(b, "v", "full_outer").agg(F.count("l").alias("left_distinct"), F.count("r").alias("right_distinct"), F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)).alias("shared"), F.count("*").alias("all"))
    return both.select("left_distinct", "right_distinct", "shared", F.when(F.col("all") == 0, 0.0).otherwise(F.col("shared") / F.col("all")).alias("jaccard"))
