"""Bounded samples of labelled rows, and the split into learning and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(labels: DataFrame, label: str, most: int, id_col: str = "doc_id", where: Column | None = None) -> tuple[DataFrame, dict]:
    """Ids of at most ``most`` labelled rows (half for each value, the smallest hashes first), and rows there are of each value.

    Ids with several labels count with the largest. The sample is a table of at most ``most`` ids.
    """
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    rows = rows.filter(where) if where is not None else rows
    rows = rows.groupBy(F.col(id_col).alias("label_id")).agg(F.max(label).cast("int").alias("y"))
    there = {int(r["y"]): r["count"] for r in rows.groupBy("y").count().collect()}
    turn = [F.xxhash64("label_id"), F.col("label_id")]
    parts = [rows.filter(F.col("y") == y).orderBy(*turn).limit(max(most // 2, most - there.get(1 - y, 0))) for y in (0, 1)]
    return cut(parts[0].union(parts[1])), there
