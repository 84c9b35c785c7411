"""Secret scans with corpus-wide ownership.

Native: DataFrame functions only. Every match of a kind is marked in the text by sentinels and
the text split at them, which gives matches with their places. Candidate values are then counted
over distinct repositories and owners: those that many owners share are examples that were
copied around, those of few owners that look random are reported as live.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run is matched whole, so patterns of runs can ask for the least length: shorter runs fail either way.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: kind, pattern, group of the value, least length of the value. Order breaks ties of start.
BASE = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
#: The method's own kind: long runs with letters and digits, reported only where few owners have them.
OWNED = ("owned", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
#: One of these is in any text, lower-cased, that a kind can match: cheaper to look for than the pattern.
_HINTS = {"assign": ("password", "passwd", "secret", "token", "api_key", "apikey"), "access": ("akia",)}
#: Parts of a text that are folded at once.
_FOLD = 256
#: A value that so many owners have is a copied example.
COPIED_OWNERS = 5
#: Most hot values there can be.
HOT_VALUES = 1000
#: A live-looking value has at least so many different characters.
LEAST_DISTINCT = 8
#: Private-use code points that mark matches; in the text they count as any other that no pattern takes.
_OPEN, _CLOSE, _OTHER = "", "", "�"


def _spans(text: Column, kind: str, pattern: str, group: int, least: int, order: int) -> Column:
    """array<struct<start, order, end, kind, value>> of matches, leftmost and non-overlapping; failing ones dropped.

    Parts are folded in runs of _FOLD, then the runs, so a text with very many matches isn't copied for each.
    """
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{_OPEN}$1{_CLOSE}"), f"[{_OPEN}{_CLOSE}]", -1)
    none = F.expr("CAST(array() AS array<struct<start:int,order:int,end:int,kind:string,value:string>>)")

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x)
        value = F.regexp_extract(x, pattern, group) if group else x
        span = F.struct(acc["at"].alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(kind).alias("kind"), value.alias("value"))
        # odd parts are matches
        found = F.when(acc["odd"] & (F.length(value) >= least), F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), found.alias("found"))

    def run(n: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), none.alias("found"))
        return F.aggregate(F.slice(parts, n * _FOLD + 1, _FOLD), start, step, lambda acc: F.struct(acc["at"].alias("size"), acc["found"].alias("found")))

    def join(acc: Column, x: Column) -> Column:
        at = acc["at"]
        moved = F.transform(x["found"], lambda s: F.struct((s["start"] + at).alias("start"), s["order"].alias("order"), (s["end"] + at).alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
        return F.struct((at + x["size"]).alias("at"), F.concat(acc["found"], F.array(moved)).alias("found"))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _FOLD).cast("int")), run)
    all_ = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array(none).alias("found")), join, lambda acc: F.flatten(acc["found"]))
    may = text.rlike(pattern)
    if hints := _HINTS.get(kind):
        may = reduce(lambda a, b: a | b, [F.lower(text).contains(h) for h in hints]) & may
    return F.when(may, all_).otherwise(none)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _salted(at: DataFrame, counts: DataFrame) -> DataFrame:
    """at joined with counts on the hash; hot values, of a thousandth of all spans or more and so a thousand at most, are broadcast."""
    hot = F.col("m") * HOT_VALUES >= (counts.agg(F.sum("m")).first()[0] or 0)
    known = counts.filter(hot).select("hash", F.col("n_repos").alias("r"), F.col("n_owners").alias("o"))
    at = at.join(F.broadcast(known), "hash", "left")
    found = at.filter("r IS NOT NULL").withColumnsRenamed({"r": "n_repos", "o": "n_owners"})
    return at.filter("r IS NULL").drop("r", "o").join(counts.filter(~hot).drop("m"), "hash").unionByName(found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_cols: tuple = ("doc_id",), owner_col: str = "source", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Per row of ``docs``: id, base (spans of the three base kinds), spans (with the owned ones).

    A span has kind, start, end (code points, end exclusive), value, and, from the whole corpus,
    n_repos, n_owners and verdict: ``copied`` (at least ``copied_owners`` owners), ``plain`` (too
    few different characters) or ``live``. A repository belongs to its owner: it is owner and
    ``repo_cols`` together. Owned candidates overlap no base span and stay only when live.

    Null text is empty; texts of any length are scanned whole. Null owners form one owner.
    Repeated rows are scanned one by one and count as one repository; spans of equal start are in
    the order of their kinds. Columns beside these are not read, whatever their names. An empty
    table gives no rows.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _OPEN + _CLOSE, _OTHER * 2)
    found = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("finger"), F.col(owner_col).alias("owner"),
        F.xxhash64(*[F.col(c) for c in repo_cols]).alias("repo"), text.alias("text"),
    )
    kinds = [*BASE, OWNED]
    found = found.withColumns({kind: _spans(F.col("text"), kind, pattern, group, least, k) for k, (kind, pattern, group, least) in enumerate(kinds)})
    base = F.array_sort(reduce(F.concat, [F.col(kind) for kind, *_ in BASE]))
    mixed = F.filter("owned", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    found = found.select("id", "finger", "owner", "repo", base.alias("base"), mixed.alias("owned"))
    owned = F.filter("owned", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    found = cut(found.select("id", "finger", "owner", "repo", "base", owned.alias("owned")))

    each = found.select("owner", "repo", F.explode(F.concat("base", "owned")).alias("span")).select("owner", "repo", F.md5("span.value").alias("hash"))
    counts = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("m")).groupBy("hash", "owner").agg(F.count("*").alias("n"), F.sum("m").alias("m")).groupBy("hash")
    counts = cut(counts.agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("m").alias("m")))

    at = found.select("id", "finger", F.explode(F.concat("base", "owned")).alias("span")).distinct().withColumn("hash", F.md5("span.value"))
    variety = F.size(F.array_distinct(F.split("span.value", "")))
    verdict = F.when(F.col("n_owners") >= copied_owners, "copied").when(variety < LEAST_DISTINCT, "plain").otherwise("live")
    at = _salted(at, counts).withColumn("verdict", verdict).filter((F.col("span.kind") != "owned") | (F.col("verdict") == "live"))
    told = F.struct("span.start", "span.order", "span.end", "span.kind", "span.value", "n_repos", "n_owners", "verdict")
    at = at.groupBy(F.col("id").alias("i"), F.col("finger").alias("f")).agg(F.array_sort(F.collect_list(told)).alias("spans"))
    rows = found.select("id", "finger", "base").join(at, F.col("id").eqNullSafe(F.col("i")) & (F.col("finger") == F.col("f")), "left")
    none = F.expr("CAST(array() AS array<struct<start:int,order:int,end:int,kind:string,value:string,n_repos:bigint,n_owners:bigint,verdict:string>>)")
    return rows.select(F.col("id").alias(id_col), "base", F.coalesce("spans", none).alias("spans"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    m = lambda verdict: F.size(F.filter("spans", lambda s: s["verdict"] == verdict)).cast("long")
    return scanned.select(
        id_col, *[n(kind).alias(f"n_{kind}") for kind, *_ in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"), m("live").alias("n_live"), m("copied").alias("n_copied"),
    )


def _oracle() -> str:
    """DuckDB, the same way: matches marked by sentinels, the text split at them, places from running lengths."""
    sql = "WITH docs AS (SELECT doc_id, source, translate(coalesce(text, ''), chr(57584) || chr(57585), chr(65533) || chr(65533)) AS text FROM documents)"
    each = []
    for k, (kind, pattern, group, least) in enumerate([*BASE, OWNED]):
        quoted = pattern.replace("'", "''")
        value = f"regexp_extract(part, '{quoted}', {group})" if group else "part"
        sql += f""", p{k} AS (
  SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i
  FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '({quoted})', chr(57584) || '\\1' || chr(57585), 'g'), '[' || chr(57584) || chr(57585) || ']') AS parts FROM docs)
), s{k} AS (
  SELECT doc_id, i, part, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM p{k}
)"""
        each.append(f"SELECT doc_id, {k} AS ord, '{kind}' AS kind, (stop - length(part))::BIGINT AS start, stop::BIGINT AS stop, {value} AS value FROM s{k} WHERE i % 2 = 0 AND length({value}) >= {least}")
    return (
        sql
        + f""", base AS ({" UNION ALL ".join(each[:3])}), own AS (
  SELECT o.* FROM ({each[3]}) o
  WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.start < o.stop AND o.start < b.stop)
), allspans AS (SELECT * FROM base UNION ALL SELECT * FROM own
), counts AS (SELECT value, count(DISTINCT source) AS owners FROM allspans JOIN docs USING (doc_id) GROUP BY value
), told AS (
  SELECT a.*, CASE WHEN owners >= {COPIED_OWNERS} THEN 'copied' WHEN len(list_distinct(string_split(value, ''))) < {LEAST_DISTINCT} THEN 'plain' ELSE 'live' END AS verdict
  FROM allspans a JOIN counts USING (value)
), kept AS (SELECT * FROM told WHERE kind <> 'owned' OR verdict = 'live')
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (kind <> 'owned'), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (kind IS NOT NULL), '') AS spans,
       count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'copied') AS n_copied
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""
    )


ORACLE = _oracle()
