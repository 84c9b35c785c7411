"""Line dedup: lines that several documents hold stay in one document only.

Native: DataFrame functions only. Lines travel as 128-bit key hashes with a position; the
text itself is shuffled once, when each document meets its list of dropped positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, cut, put

#: Most hot keys there can be, and the tasks that share one.
HOT_KEYS, SALTS = 1000, 64


def _keys(text: Column) -> Column:
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)))


def _kept(lines: Column, drop: Column) -> Column:
    """The lines between dropped positions (sorted), each slice copied once: linear in the lines."""
    n, k = F.size(lines), F.size(drop)

    def between(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(drop, i - 1) + 1)
        end = F.when(i == k, n).otherwise(F.get(drop, i))
        return F.slice(lines, start + 1, end - start)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), k), between)), "\n")


def _salted(line: DataFrame, held: DataFrame) -> DataFrame:
    """line joined with held on the key's hashes; lines of hot keys are dealt to SALTS tasks.

    A hot key has a thousandth of all lines of held keys or more, so there are at most a
    thousand, and these alone are broadcast.
    """
    lines = held.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_KEYS >= lines
    known = held.filter(hot).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.lit(True).alias("hot"))
    line = line.join(F.broadcast(known), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    line = line.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int")).drop("k1", "k2", "hot")
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return line.join(held.select("h1", "h2", "home", F.explode(salts).alias("salt")), ["h1", "h2", "salt"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """The rows of ``docs`` with deduplicated text, plus ``n_lines`` and ``n_dropped``.

    A line's key is the line without white space at its ends, A-Z lower-cased. A key of at
    least ``min_chars`` code points that at least ``min_docs`` documents hold loses its lines
    everywhere but in the document with the smallest id.

    Null or empty text is one empty line. Rows that repeat an id count as one document. A null
    id is no document: its lines are neither counted nor dropped. Columns named ``n_lines``
    or ``n_dropped`` are replaced; all others pass through. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    finger = F.xxhash64(text)
    line = (
        docs.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), finger.alias("finger"), F.posexplode(_keys(text)).alias("pos", "key"))
        .filter(F.length("key") >= min_chars)
        .select("id", "finger", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    if min_docs == 2:
        held = line.groupBy("h1", "h2").agg(F.min("id").alias("home"), F.max("id").alias("other"), F.count("*").alias("n")).filter("home <> other")
    else:
        held = line.groupBy("h1", "h2", "id").agg(F.count("*").alias("m")).groupBy("h1", "h2").agg(F.min("id").alias("home"), F.count("*").alias("d"), F.sum("m").alias("n")).filter(F.col("d") >= min_docs)
    held = cut(held.select("h1", "h2", "home", "n"))
    drop = (
        _salted(line, held)
        .filter("id <> home")
        .groupBy(F.col("id").alias("__id"), F.col("finger").alias("__finger"))
        .agg(F.sort_array(F.collect_set("pos")).alias("__drop"))
    )
    rows = docs.withColumn("__finger_of", finger)
    rows = rows.join(drop.hint("shuffle_hash"), (F.col(id_col) == F.col("__id")) & (F.col("__finger_of") == F.col("__finger")), "left")
    lines = F.split(text, "\n", -1)
    n_dropped = F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long")
    out = {
        text_col: F.when(F.col("__drop").isNull(), text).otherwise(_kept(lines, F.col("__drop"))),
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": n_dropped,
    }
    order = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    return put(rows, out).select(*[F.col(f"`{c}`") for c in order])


ORACLE = """
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line
), held AS (
  SELECT key, min(doc_id) AS home FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.home AS dropped FROM keyed k LEFT JOIN held h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
