"""Mixing sources to target weights along a time-varying curriculum.

Each source's weight schedule over training time [0, 1] is integrated; a document's place in
its source's stream of words is turned into a training position by inverting that cumulative
demand; rows are then range-sorted by position. A source's stream is ordered by a hash of the
document id, and its running sums come in two levels (buckets of hashes, then rows within a
bucket), so no task holds a whole source. A bucket that an often repeated id makes heavy is dealt
into finer ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, row_print

#: (weight at the start, weight at the end) of the linear schedule, by weight class; each averages 1.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
MAX_REPEAT = 3
#: About so many rows share a bucket of hashes within a source; a bucket with HEAVY times as many is split.
BUCKET_ROWS, HEAVY = 20_000, 8


def source_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size -> rank, weight, target: min(max_repeat * size, level * weight), the level such that targets sum to all sizes.

    That is where resharing of the excess ends: sources that reach their limit, taken in
    order of limit per weight, are settled first, and the rest share what is left by weight.
    One row per source, so the unpartitioned windows see a small summary only.
    """
    everything = W.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", F.col("rank") % 3 + 1)
    ranked = ranked.withColumn("limit", F.col("source_size") * max_repeat).withColumn("full_at", F.col("limit") / F.col("weight"))
    before = W.orderBy("full_at", "rank").rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    ranked = ranked.withColumn("level", level.cast("double"))
    # the first source in that order that isn't full settles the level for all after it
    open_ = F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank"))
    ranked = ranked.withColumn("settled", F.min_by("level", open_).over(everything))
    target = F.least(F.col("limit").cast("double"), F.col("settled") * F.col("weight"))
    return ranked.select("source", "source_size", "rank", "weight", target.alias("target"))


def position_of(share: Column, start: Column, end: Column) -> Column:
    """The time at which a linear schedule from start to end has handed out this share of its integral."""
    slope = end - start
    area = share * (start + end) / 2
    return F.when(slope == 0, share).otherwise((F.sqrt(F.greatest(start * start + 2 * slope * area, F.lit(0.0))) - start) / slope)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeat: int = MAX_REPEAT, schedules: tuple = SCHEDULES) -> DataFrame:
    """Per row of ``docs``: id, finger (of the text), row (fingerprint of all columns), size, source_size, target, taken, and ``passes``.

    ``passes`` lists for each time the mix takes the document its training position and the
    words taken. A source's rows are taken in the order of a hash of the id, again from the
    start when all are used, until the (rounded) target is reached; the last may be cut short.
    So a source takes its target to the word, a document at most max_repeat times its size.

    Null text has size 0 and is never taken. Null sources form one source, ranked last. A null
    id hashes as an empty one. Repeated rows are taken one by one, rows that repeat an id in the
    order of their sizes and fingerprints. Texts of any length are counted whole. Columns beside
    id, text and source only enter ``row``, whatever their names. An empty table gives no rows.
    """
    text = F.col(text_col)
    sized = cut(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("finger"), row_print(docs).alias("row"), F.monotonically_increasing_id().alias("nth"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("turn"),
        )
    )
    digits = max(1, min(6, len(f"{sized.count() // BUCKET_ROWS:x}")))
    sized = sized.withColumn("bucket", F.substring("turn", 1, digits))
    # rows of one id part by their fingerprints; wholly equal rows, which may take any turn of theirs, by their number
    for finer in ((F.col("turn"), F.pmod(F.xxhash64("row"), F.col("parts"))), (F.hex("row"), F.pmod(F.xxhash64("nth"), F.col("parts")))):
        # each holds HEAVY * BUCKET_ROWS rows at least, so they are few against the rows
        heavy = cut(sized.groupBy(F.col("source").alias("s"), F.col("bucket").alias("b")).agg(F.ceil(F.count("*") / BUCKET_ROWS).alias("parts")).filter(F.col("parts") > HEAVY))
        if heavy.isEmpty():
            break
        sized = sized.join(F.broadcast(heavy), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "left")
        finer = F.concat_ws("-", "bucket", *[x.cast("string") for x in finer])
        sized = sized.withColumn("bucket", F.when(F.col("parts").isNull(), F.col("bucket")).otherwise(finer)).drop("s", "b", "parts")
    by_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    in_order = W.partitionBy("source").orderBy("bucket")
    by_bucket = by_bucket.withColumn("before", F.sum("in_bucket").over(in_order) - F.col("in_bucket"))
    goal = source_targets(by_bucket.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), max_repeat)
    known = by_bucket.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before").join(goal.withColumnRenamed("source", "g"), F.col("s").eqNullSafe(F.col("g"))).drop("g")
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    within = W.partitionBy("source", "bucket").orderBy("turn", "id", "size", "finger", "row", "nth").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.col("before") + F.sum("size").over(within) - F.col("size"))
    goal_words = F.floor(F.col("target") + 0.5)
    start = F.element_at(F.array(*[F.lit(float(a)) for a, _ in schedules]), (F.col("rank") % len(schedules) + 1).cast("int"))
    end = F.element_at(F.array(*[F.lit(float(b)) for _, b in schedules]), (F.col("rank") % len(schedules) + 1).cast("int"))
    passes = []
    for k in range(max_repeat):
        offset = F.col("at") + k * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), goal_words - offset)).cast("long")
        share = F.when(goal_words > 0, F.least(F.lit(1.0), offset / goal_words)).otherwise(F.lit(0.0))
        passes.append(F.struct(position_of(share, start, end).alias("position"), words.alias("words")))
    rows = rows.withColumn("passes", F.filter(F.array(*passes), lambda x: x["words"] > 0))
    rows = rows.withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x["words"]))
    return rows.select(F.col("id").alias(id_col), "finger", "row", "size", "source_size", "target", "taken", "passes")


def by_first_turn(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``mix_sources``, range-sorted by the position at which the mix first takes them; those never taken last, in order of id."""
    return mixed.orderBy(F.get("passes", F.lit(0))["position"].asc_nulls_last(), id_col, "finger")


def turns(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, turn (from 1), position, words: a row for each time the mix takes a document, range-sorted by position."""
    each = mixed.select(id_col, "finger", F.posexplode("passes").alias("k", "pass"))
    each = each.select(id_col, "finger", (F.col("k") + 1).alias("turn"), "pass.position", "pass.words")
    return each.orderBy("position", id_col, "turn", "finger").drop("finger")


def in_training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The documents the mix takes, a row for each time, range-sorted by training position; input columns only.

    The last pass over a source may stop inside a document: the row then stays if at least
    half of its words are taken. Rows never taken are gone. Rows that share an id, or id and
    text, keep turns of their own; wholly equal rows are alike. An empty table gives no rows.
    """
    mixed = mix_sources(docs, id_col, text_col, source_col, **kw).withColumn("__id", _key(F.col(id_col)))
    whole = F.filter("passes", lambda x: x["words"] * 2 >= F.col("size"))
    turns = cut(mixed.select("__id", F.col("row").alias("__row"), F.explode(F.transform(whole, lambda x: x["position"])).alias("__position")))
    again = cut(mixed.groupBy("__id", F.col("row").alias("__row")).agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    rows, key, kind = docs.withColumns({"__id": _key(F.col(id_col)), "__row": row_print(docs)}), ["__id", "__row"], "shuffle_hash"
    if not again.isEmpty():  # of wholly equal rows one stands for all, with the turns of all
        rows = rows.join(again, key, "left_semi").dropDuplicates(key).unionByName(rows.join(again, key, "left_anti"))
        kind = "merge"  # which may split a key with many turns
    rows = rows.join(turns.hint(kind), key)
    return rows.orderBy("__position", "__id", "__row").select(*[F.col(f"`{c}`") for c in docs.columns])


def _key(id_: Column) -> Column:
    """Not null, so that plain equality finds every row."""
    return F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit(""))


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS turn FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source
), lim AS (
  SELECT *, rank % 3 + 1 AS weight, 3 * source_size AS lim, 3 * source_size / (rank % 3 + 1) AS full_at FROM src
), lev AS (
  SELECT *, row_number() OVER (ORDER BY full_at, rank) AS nth, (sum(source_size) OVER () - coalesce(sum(lim) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM lim WINDOW w AS (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
  SELECT *, least(lim::DOUBLE, arg_min(level, nth) FILTER (level <= full_at) OVER () * weight) AS target FROM lev
), placed AS (
  SELECT s.*, g.source_size, g.target, sum(s.size) OVER (PARTITION BY s.source ORDER BY turn, doc_id ROWS UNBOUNDED PRECEDING) - s.size AS start
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target + 0.5)::BIGINT - start)) + greatest(0, least(size, floor(target + 0.5)::BIGINT - start - source_size))
        + greatest(0, least(size, floor(target + 0.5)::BIGINT - start - 2 * source_size)))::BIGINT AS taken
FROM placed
"""
