"""Named queries over the test tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import canonical as cn
from ..functions import names, texts
from ..functions import types as ty
from ..operators.profile import profile_table, set_fingerprints
from ..operators.relations import min_hash_similarity
from ..options import ProfileOptions
from ..sources import table_list
from ..sources.tables import from_files, lob_stats
from .longform import column_infos, value_counts, with_values

#: Columns of the test tables and how their cells become text: i whole number, d double, s string, t timestamp.
TABLES = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:i ts:t user_id:i event_type:s value:d props:s",
    "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "conversations": "conv_id:i turn:i role:s text:s",
    "labels": "doc_id:i quality:i toxic:i",
    "pages": "page_id:i url:s html:s",
    "benchmark": "item_id:i text:s",
}
#: Projections with missing, untrimmed, differently cased, constant and nearly constant values, the same in both engines.
DIRTY = {
    "dirty_orders": (
        "orders",
        {
            "id:i": "o_orderkey",
            "priority:s": "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN ' n/a ' WHEN o_orderkey % 17 = 0 THEN lower(o_orderpriority) WHEN o_orderkey % 19 = 0 THEN concat(' ', o_orderpriority) ELSE o_orderpriority END",
            "customer:i": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END",
            "price:d": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END",
            "same:s": "'CRM'",
            "nearly:s": "CASE WHEN o_orderkey = 3 THEN 'b' ELSE 'a' END",
            "none:s": "CASE WHEN o_orderkey < 0 THEN 'x' END",
            "wide:s": "CASE WHEN o_orderkey % 3 = 0 THEN concat('中文', o_orderkey % 10) WHEN o_orderkey % 3 = 1 THEN concat('a😀', o_orderkey % 4) ELSE concat('x_', o_orderkey % 5, '-', o_orderstatus) END",
        },
    ),
    "dirty_customer": (
        "customer",
        {
            "id:i": "c_custkey",
            "segment:s": "CASE WHEN c_custkey % 10 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 10 = 1 THEN concat(c_mktsegment, '  ') WHEN c_custkey % 10 = 2 THEN 'NULL' WHEN c_custkey % 10 = 3 THEN '   ' ELSE c_mktsegment END",
            "phone:s": "CASE WHEN c_custkey % 50 = 7 THEN '138-1234-5678' ELSE concat('138', 10000000 + c_custkey) END",
            "code:s": "concat(substr('abcdefghijklmnopqrstuvwxyz', 1, CAST(c_custkey % 13 AS INT) + 1), substr('--------------------', 1, CAST(c_custkey % 17 AS INT)), c_custkey % 10)",
        },
    ),
}
_EVERYTHING = ProfileOptions().everything()


def _columns(name: str) -> list[tuple[str, str]]:
    parts = DIRTY[name][1] if name in DIRTY else TABLES[name].split()
    return [tuple(p.split(":")) for p in parts]


def _frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, projection = DIRTY.get(name, (name, None))
    df = from_files(spark, f"{sf_dir}/{table}.parquet")
    return df.selectExpr(*[f"{e} AS `{k.split(':')[0]}`" for k, e in projection.items()]) if projection else df


_VALUE_TEXT = "array_join(transform(values, v -> concat(v.value, '=', v.count)), '|')"
_FIELDS = (
    "name row_count null_count null_rate blank_count semantic_null_count non_null_count distinct_count uniqueness min_value max_value min_length max_length avg_length trim_changed_count "
    "candidate_primary_key constant quasi_constant low_cardinality potential_enum lob_content_skipped value_text"
).split()


#: Fields that ask for a metric of the options.
_NEEDS = {
    "distinct_enabled": {"distinct_count", "uniqueness", "candidate_primary_key", "constant", "potential_enum", "low_cardinality", "quasi_constant", "value_text"},
    "value_frequency_enabled": {"low_cardinality", "quasi_constant", "value_text"},
    "range_enabled": {"min_value", "max_value"},
    "length_enabled": {"min_length", "max_length", "avg_length"},
}


def _options(fields) -> ProfileOptions:
    """Metrics that none of the fields shows are off."""
    return ProfileOptions(**{option: bool(needs & set(fields)) for option, needs in _NEEDS.items()})


def _profile(spark: SparkSession, sf_dir: str, name: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    df = profile_table(_frame(spark, sf_dir, name), _options(fields or _FIELDS))
    return df.withColumn("value_text", F.expr(_VALUE_TEXT)).select(*(fields or _FIELDS))


_TRIM = "regexp_replace(regexp_replace({c}, '^[\\x00-\\x20]+', ''), '[\\x00-\\x20]+$', '')"
_NUMBER = "regexp_replace(regexp_replace(CAST(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38,18)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
_TIME = "CASE WHEN contains(CAST({c} AS VARCHAR), '.') THEN CAST({c} AS VARCHAR) ELSE CAST({c} AS VARCHAR) || '.0' END"


def _cells_sql(name: str) -> str:
    """CTEs up to ``cell``: a row per cell with value (profiled canonical text), len, key (comparable) and the counters."""
    table, projection = DIRTY.get(name, (name, None))
    source = f"SELECT {', '.join(f'{e} AS {k.split(':')[0]}' for k, e in projection.items())} FROM {table}" if projection else f"SELECT * FROM {table}"
    parts = []
    for i, (c, kind) in enumerate(_columns(name)):
        trimmed = _TRIM.format(c=c)
        value = {"i": f"CAST({c} AS VARCHAR)", "d": _NUMBER.format(c=c), "t": _TIME.format(c=c), "s": trimmed}[kind]
        key = {"i": f"CAST({c} AS DOUBLE)", "d": c, "t": f"CAST(epoch_us({c}) AS DOUBLE)", "s": "CAST(NULL AS DOUBLE)"}[kind]
        text = kind == "s"
        blank = f"coalesce({trimmed} = '', false)" if text else "false"
        semantic = f"coalesce(upper({trimmed}) IN ('NULL', 'N/A', 'NA'), false)" if text else "false"
        units = f"length({c}) + length(regexp_replace({c}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))" if text else "CAST(NULL AS BIGINT)"
        parts.append(f"SELECT {i + 1} AS ordinal, '{c}' AS name, {c} IS NULL AS missing, {blank} AS blank, {semantic} AS semantic, {f'coalesce({trimmed} <> {c}, false)' if text else 'false'} AS trimmed, {value} AS v, {units} AS units, {key} AS k FROM src")
    return f"WITH src AS ({source}), raw AS ({' UNION ALL '.join(parts)}), cell AS (SELECT *, CASE WHEN NOT blank AND NOT semantic THEN v END AS value, CASE WHEN NOT blank AND NOT semantic THEN units END AS len FROM raw)"


def _profile_sql(name: str, fields: tuple[str, ...] | None = None) -> str:
    return (
        _cells_sql(name)
        + """, vc AS (SELECT ordinal, value, count(*) AS n FROM cell WHERE value IS NOT NULL GROUP BY ordinal, value
), ranked AS (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY n DESC, value) AS nth, count(*) OVER (PARTITION BY ordinal) AS distinct_n, sum(n) OVER (PARTITION BY ordinal) AS profiled FROM vc
), top AS (SELECT ordinal, string_agg(value || '=' || n, '|' ORDER BY nth) AS value_text, max(n / profiled) AS share FROM ranked WHERE distinct_n <= 100 AND nth <= CASE WHEN distinct_n <= 20 THEN distinct_n ELSE 20 END GROUP BY ordinal
), agg AS (
  SELECT ordinal, name, count(*) AS row_count, count(*) FILTER (missing) AS null_count, count(*) FILTER (blank) AS blank_count, count(*) FILTER (semantic) AS semantic_null_count, count(*) FILTER (NOT missing) AS non_null_count,
    count(DISTINCT value) AS distinct_count, count(value) AS profiled, arg_min(value, k) AS min_value, arg_max(value, k) AS max_value, min(len) AS min_length, max(len) AS max_length, sum(len)::DOUBLE / count(len) AS avg_length, count(*) FILTER (trimmed) AS trim_changed_count
  FROM cell GROUP BY ordinal, name
), full_profile AS (
  SELECT name, row_count, null_count, null_count / row_count AS null_rate, blank_count, semantic_null_count, non_null_count, distinct_count, CASE WHEN profiled = 0 THEN 0.0::DOUBLE ELSE distinct_count / profiled END AS uniqueness,
    min_value, max_value, min_length, max_length, CASE WHEN isnan(avg_length) THEN NULL ELSE avg_length END AS avg_length, trim_changed_count, null_count = 0 AND blank_count = 0 AND semantic_null_count = 0 AND distinct_count = row_count AS candidate_primary_key,
    distinct_count = 1 AS constant, coalesce(share >= 0.99, false) AS quasi_constant, distinct_count <= 100 AS low_cardinality, distinct_count BETWEEN 1 AND 20 AS potential_enum, false AS lob_content_skipped, coalesce(value_text, '') AS value_text
  FROM agg LEFT JOIN top USING (ordinal)
)
"""
        + f"SELECT {', '.join(fields or _FIELDS)} FROM full_profile"
    )


QUERIES: dict = {}
ORACLES: dict = {}

#: query -> table, fields of its profile
_PARTS = {
    "column_null_profile": ("dirty_orders", "name row_count null_count non_null_count null_rate"),
    "missing_value_profile": ("dirty_orders", "name blank_count semantic_null_count trim_changed_count non_null_count"),
    "exact_distinct_uniqueness": ("lineitem", "name row_count distinct_count uniqueness"),
    "value_frequency_low_card": ("events", "name distinct_count low_cardinality value_text"),
    "enum_values": ("dirty_orders", "name potential_enum value_text"),
    "topn_values": ("part", "name distinct_count value_text"),
    "numeric_range": ("customer", "name min_value max_value"),
    "temporal_range": ("events", "name min_value max_value"),
    "string_length_stats": ("conversations", "name min_length max_length avg_length"),
    "utf16_length_stats": ("dirty_orders", "name min_length max_length avg_length"),
    "candidate_keys": ("customer", "name candidate_primary_key"),
    "constant_flags": ("dirty_orders", "name constant distinct_count"),
    "quasi_constant_flags": ("dirty_orders", "name quasi_constant"),
    "low_cardinality_flags": ("lineitem", "name low_cardinality"),
    "potential_enums": ("orders", "name potential_enum"),
    "trim_changed": ("dirty_customer", "name trim_changed_count blank_count"),
}
for _q, (_t, _f) in _PARTS.items():
    QUERIES[_q] = partial(_profile, name=_t, fields=tuple(_f.split()))
    ORACLES[_q] = _profile_sql(_t, tuple(_f.split()))
for _t in [*TABLES, *DIRTY]:
    QUERIES[f"table_profile_{_t}"] = partial(_profile, name=_t)
    ORACLES[f"table_profile_{_t}"] = _profile_sql(_t)


def _query(f, sql: str | None = None):
    QUERIES[f.__name__] = f
    if sql:
        ORACLES[f.__name__] = sql
    return f


def lob_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = from_files(spark, f"{sf_dir}/pages.parquet")
    df = profile_table(pages.select("page_id", "html"), lobs={"html": "CLOB"}).filter("name = 'html'")
    return df.select("name", "family", "non_null_count", "distinct_count", "min_length", "max_length", "avg_length", "lob_content_skipped", "low_cardinality")


_query(
    lob_length_stats,
    "SELECT 'html' AS name, 'LOB' AS family, count(html) AS non_null_count, 0::BIGINT AS distinct_count, min(length(html)) AS min_length, max(length(html)) AS max_length, sum(length(html))::DOUBLE / count(html) AS avg_length, true AS lob_content_skipped, true AS low_cardinality FROM pages",
)


def lob_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lob_stats(from_files(spark, f"{sf_dir}/pages.parquet"), "html", preview=16)


_query(lob_values, "SELECT 'CLOB' AS kind, length(html) AS length, substr(html, 1, 16) AS preview FROM pages")


def case_variant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = profile_table(_frame(spark, sf_dir, "dirty_customer"), ProfileOptions(case_variant_tracking_enabled=True))
    return df.select("name", "case_variant_group_count")


_STRINGS = ", ".join(f"'{c}'" for t in DIRTY for c, k in _columns(t) if k == "s")
_query(
    case_variant_groups,
    _cells_sql("dirty_customer")
    + f""", folded AS (SELECT name, lower(value) AS f, count(DISTINCT value) AS spellings FROM cell WHERE value IS NOT NULL AND name IN ({_STRINGS}) GROUP BY ALL
), found AS (SELECT name, CASE WHEN count(*) > 100 THEN 0 ELSE count(*) FILTER (spellings > 1) END AS c FROM folded GROUP BY name)
SELECT name, coalesce(c, 0)::INTEGER AS case_variant_group_count FROM (SELECT DISTINCT name FROM cell) LEFT JOIN found USING (name)""",
)


def _patterns(spark: SparkSession, sf_dir: str, name: str, limit: int = 128) -> DataFrame:
    df = profile_table(_frame(spark, sf_dir, name), ProfileOptions(pattern_profile_enabled=True, pattern_limit=limit))
    return df.select("name", F.posexplode("patterns").alias("nth", "p")).select("name", (F.col("nth") + 1).cast("long").alias("nth"), "p.pattern", F.col("p.count").alias("n"))


# marks as in the engine, one code point each; then each run of a mark becomes its letter and length
_MARKS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(value, '[^\\p{Nd}\\p{Han}\\p{L}\\s\\-_/.:@#]', '', 'g'), '\\p{Nd}', '', 'g'), '\\p{Han}', '', 'g'), '\\p{L}', '', 'g'), '\\s', '', 'g')"
_PATTERN_OF = "array_to_string(list_transform(regexp_extract_all(m, '+|+|+|+|+|[\\-_/.:@#]'), lambda r: CASE WHEN r[1] = '' THEN 'D' || length(r) WHEN r[1] = '' THEN 'C' || length(r) WHEN r[1] = '' THEN 'L' || length(r) WHEN r[1] = '' THEN 'W' || length(r) WHEN r[1] = '' THEN 'S' || length(r) ELSE r END), '')"


def _pattern_sql(name: str, limit: int) -> str:
    return (
        _cells_sql(name)
        + f""", marked AS (SELECT ordinal, name, {_MARKS} AS m FROM cell WHERE value IS NOT NULL AND name IN ({_STRINGS})
), counted AS (SELECT name, {_PATTERN_OF} AS pattern, count(*) AS n FROM marked GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, pattern) AS r FROM counted
), pooled AS (SELECT name, CASE WHEN r <= {limit} THEN pattern ELSE 'OTHER' END AS pattern, sum(n)::BIGINT AS n FROM ranked GROUP BY ALL)
SELECT name, row_number() OVER (PARTITION BY name ORDER BY n DESC, pattern) AS nth, pattern, n FROM pooled QUALIFY nth <= 20"""
    )


QUERIES["pattern_frequency"] = partial(_patterns, name="dirty_orders")
ORACLES["pattern_frequency"] = _pattern_sql("dirty_orders", 128)
QUERIES["pattern_overflow_other"] = partial(_patterns, name="dirty_customer", limit=12)
ORACLES["pattern_overflow_other"] = _pattern_sql("dirty_customer", 12)


def string_shape_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = profile_table(_frame(spark, sf_dir, "dirty_orders"), ProfileOptions(string_shape_enabled=True))
    return df.select("name", *[F.col(f"shape.{s}").alias(s) for s in cn.SHAPES])


_query(
    string_shape_stats,
    _cells_sql("dirty_orders")
    + f""", kinds AS (SELECT name, regexp_matches(value, '\\p{{Nd}}') AS d, regexp_matches(value, '\\p{{Han}}') AS h, regexp_matches(regexp_replace(value, '\\p{{Han}}', '', 'g'), '\\p{{L}}') AS l, regexp_matches(value, '\\s') AS w, regexp_matches(value, '[^\\p{{Nd}}\\p{{L}}\\s]') AS s
  FROM cell WHERE value IS NOT NULL AND name IN ({_STRINGS})
), sums AS (SELECT name, count(*) FILTER (d AND NOT l AND NOT h AND NOT w AND NOT s) AS a, count(*) FILTER (l AND NOT d AND NOT h AND NOT w AND NOT s) AS b, count(*) FILTER (d AND l AND NOT h AND NOT w AND NOT s) AS c, count(*) FILTER (h AND NOT d AND NOT l AND NOT w AND NOT s) AS e,
  count(*) FILTER (w) AS f, count(*) FILTER (s) AS g, count(*) FILTER (d::INT + h::INT + l::INT + w::INT + s::INT > 1) AS m FROM kinds GROUP BY name)
SELECT name, coalesce(a, 0) AS numeric_only, coalesce(b, 0) AS alphabetic_only, coalesce(c, 0) AS alphanumeric_only, coalesce(e, 0) AS chinese_only, coalesce(f, 0) AS contains_whitespace, coalesce(g, 0) AS contains_special, coalesce(m, 0) AS mixed
FROM (SELECT DISTINCT name FROM cell) LEFT JOIN sums USING (name)""",
)


#: Decimals of several scales, some with more digits than any one of the types could hold for all.
_WIDE = {
    "whole": "CAST(concat(CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '' END, o_orderkey, '00000000000000000000007') AS DECIMAL(38,0))",
    "fine": "CAST(concat(CASE WHEN o_custkey % 3 = 0 THEN '-' ELSE '' END, '0.', o_custkey, '0000000000') AS DECIMAL(38,18))",
    "price": "CAST(o_totalprice AS DECIMAL(12,2))",
    "missing": "CASE WHEN o_orderkey < 0 THEN CAST(1 AS DECIMAL(20,5)) END",
}


def decimal_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = from_files(spark, f"{sf_dir}/orders.parquet")
    return profile_table(orders.selectExpr(*[f"{e} AS {c}" for c, e in _WIDE.items()])).select("name", "min_value", "max_value", "distinct_count")


_PLAIN = "regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
_query(decimal_range, " UNION ALL ".join(f"SELECT '{c}' AS name, {_PLAIN.format(x=f'min({e})')} AS min_value, {_PLAIN.format(x=f'max({e})')} AS max_value, count(DISTINCT {e}) AS distinct_count FROM orders" for c, e in _WIDE.items()))


def canonical_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _frame(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", *[cn.canonical(F.col(c), df.schema[c].dataType).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_shipdate")])


_query(canonical_numbers, f"SELECT l_orderkey, l_linenumber, {', '.join(f'{_NUMBER.format(c=c)} AS {c}' for c in ('l_quantity', 'l_extendedprice', 'l_discount'))}, {_TIME.format(c='l_shipdate')} AS l_shipdate FROM lineitem")

_H = "CAST('0x' || substr(md5(value), 1, 15) AS BIGINT)"
_H2 = "CAST('0x' || substr(md5('#' || value), 1, 15) AS BIGINT)"
_KEYS = ("customer", "orders")


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in _KEYS:
        df = _frame(spark, sf_dir, t)
        infos = column_infos(df)
        fp = set_fingerprints(with_values(value_counts(df, infos, _EVERYTHING), infos), _EVERYTHING.min_hash_bins)
        named = F.element_at(F.create_map(*[x for i in infos for x in (F.lit(i.ordinal), F.lit(i.name))]), F.col("ordinal"))
        fp = fp.select(F.lit(t).alias("table_name"), named.alias("name"), "fingerprint.*")
        out = fp if out is None else out.union(fp)
    return out


_DISTINCT_SQL = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS table_name, name, value FROM ({_cells_sql(t)} SELECT name, value FROM cell WHERE value IS NOT NULL)" for t in _KEYS)


def set_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums as text, so that every digit is compared."""
    sums = [F.col(c).cast("string").alias(c) for c in ("hash_sum", "second_hash_sum")]
    return _fingerprints(spark, sf_dir).select("table_name", "name", "distinct_count", "hash_xor", *sums)


_query(set_fingerprint, f"SELECT table_name, name, count(*) AS distinct_count, bit_xor({_H}) AS hash_xor, sum({_H}::HUGEINT)::VARCHAR AS hash_sum, sum({_H2}::HUGEINT)::VARCHAR AS second_hash_sum FROM ({_DISTINCT_SQL}) GROUP BY ALL")


def minhash_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fingerprints(spark, sf_dir).select("table_name", "name", F.posexplode("min_hash_bins").alias("bin", "rank"))
    return rows.filter(F.col("rank") < (1 << 63) - 1).select("table_name", "name", F.col("bin").cast("long").alias("bin"), "rank")


_query(minhash_bins, f"SELECT table_name, name, {_H} % 32 AS bin, min({_H} // 32) AS rank FROM ({_DISTINCT_SQL}) GROUP BY ALL")


def minhash_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp = _fingerprints(spark, sf_dir)
    a, b = fp.filter("table_name = 'customer'").alias("a"), fp.filter("table_name = 'orders'").alias("b")
    pair = a.crossJoin(b)  # columns of two tables, not rows
    return pair.select(F.col("a.name").alias("left_name"), F.col("b.name").alias("right_name"), min_hash_similarity(F.col("a.min_hash_bins"), F.col("b.min_hash_bins")).alias("similarity"))


_BINS_SQL = f"SELECT table_name, name, {_H} % 32 AS bin, min({_H} // 32) AS rank FROM ({_DISTINCT_SQL}) GROUP BY ALL"
_query(
    minhash_similarity,
    f"""WITH bins AS ({_BINS_SQL}), l AS (SELECT DISTINCT name AS left_name FROM bins WHERE table_name = 'customer'), r AS (SELECT DISTINCT name AS right_name FROM bins WHERE table_name = 'orders')
SELECT left_name, right_name, (SELECT count(*) FROM bins a JOIN bins b ON a.bin = b.bin AND a.rank = b.rank WHERE a.table_name = 'customer' AND b.table_name = 'orders' AND a.name = left_name AND b.name = right_name)
  / (SELECT count(DISTINCT bin) FROM bins c WHERE (c.table_name = 'customer' AND c.name = left_name) OR (c.table_name = 'orders' AND c.name = right_name)) AS similarity FROM l CROSS JOIN r""",
)


def exact_set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.set_overlap(_frame(spark, sf_dir, "customer"), "c_custkey", _frame(spark, sf_dir, "orders"), "o_custkey")


_query(
    exact_set_overlap,
    "WITH a AS (SELECT DISTINCT c_custkey AS v FROM customer), b AS (SELECT DISTINCT o_custkey AS v FROM orders), j AS (SELECT a.v AS x, b.v AS y FROM a FULL JOIN b ON a.v = b.v) "
    "SELECT count(x) AS left_distinct, count(y) AS right_distinct, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS shared, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(*) AS jaccard FROM j",
)


_NAMES = [c for t in ("customer", "orders", "lineitem") for c, _ in _columns(t)] + ["customerId", "CUSTOMER_ID", "orderKey", "__"]


def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every pair of a fixed list of names."""
    a = spark.createDataFrame([(n,) for n in _NAMES], "name string")
    rows = a.select(F.col("name").alias("a")).crossJoin(a.select(F.col("name").alias("b")))
    return rows.select("a", "b", names.name_similarity(F.col("a"), F.col("b")).alias("similarity"))


_TOKENS_SQL = """norm AS (SELECT name, regexp_replace(regexp_replace(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS x FROM n
), tok AS (SELECT name, x, CASE WHEN len(t) = 0 THEN [x] ELSE t END AS t FROM (SELECT *, list_distinct(list_filter(string_split(x, '_'), lambda p: p NOT IN ('', 'id', 'code', 'no', 'key'))) AS t FROM norm))"""
_NAMED_SQL = """CASE WHEN a.x = b.x THEN 1.0::DOUBLE WHEN ends_with(a.x, b.x) OR ends_with(b.x, a.x) THEN greatest(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 0.6::DOUBLE)
  ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) END"""
_query(
    name_similarity,
    f"""WITH n AS (SELECT unnest([{", ".join(f"'{x}'" for x in _NAMES)}]) AS name), {_TOKENS_SQL}
SELECT a.name AS a, b.name AS b, {_NAMED_SQL} AS similarity FROM tok a CROSS JOIN tok b""",
)


def relationship_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = {t: api.named(profile_table(_frame(spark, sf_dir, t), ProfileOptions(relationship_fingerprint_enabled=True)), t) for t in ("nation", "customer", "supplier")}
    out = api.relationships(p["customer"], p["nation"]).union(api.relationships(p["supplier"], p["customer"]))
    return out.select("kind", "left_ref", "right_ref", "similarity", "name_similarity")


def _related_sql(left: str, right: str) -> str:
    """Value sets are compared as sets here, by their fingerprints there."""
    values = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS table_name, name, value, {fam} AS family FROM ({_cells_sql(t)} SELECT name, value FROM cell WHERE value IS NOT NULL)" for t in (left, right) for fam in (f"CASE {' '.join(f"""WHEN name = '{c}' THEN '{ {"i": ty.NUMBER, "d": ty.NUMBER, "t": ty.DATE_TIME, "s": ty.STRING}[k] }'""" for c, k in _columns(t))} END",))
    return f"""SELECT * FROM (WITH v AS ({values}), n AS (SELECT DISTINCT name FROM v), {_TOKENS_SQL},
c AS (SELECT table_name, name, family, list(DISTINCT value ORDER BY value) AS held, count(*) AS n FROM v GROUP BY ALL),
bins AS (SELECT table_name, name, {_H} % 32 AS bin, min({_H} // 32) AS rank FROM v GROUP BY ALL),
p AS (SELECT l.name AS ln, r.name AS rn, l.n AS n, l.held = r.held AS same, {_NAMED_SQL} AS name_similarity,
    (SELECT count(*) FROM bins x JOIN bins y ON x.bin = y.bin AND x.rank = y.rank WHERE x.table_name = '{left}' AND y.table_name = '{right}' AND x.name = l.name AND y.name = r.name)
    / (SELECT count(DISTINCT bin) FROM bins z WHERE (z.table_name = '{left}' AND z.name = l.name) OR (z.table_name = '{right}' AND z.name = r.name)) AS near
  FROM c l JOIN c r ON l.table_name = '{left}' AND r.table_name = '{right}' AND l.family = r.family JOIN tok a ON a.name = l.name JOIN tok b ON b.name = r.name)
SELECT CASE WHEN same AND n <= 100 THEN 'SHARED_DICTIONARY' WHEN same THEN 'SAME_VALUE_DOMAIN' ELSE 'POTENTIAL_RELATION' END AS kind, '{left}.' || ln AS left_ref, '{right}.' || rn AS right_ref,
  CASE WHEN same THEN 1.0::DOUBLE ELSE near END AS similarity, name_similarity FROM p WHERE same OR (near >= 0.45 AND name_similarity >= 0.2))"""


_query(relationship_candidates, f"{_related_sql('customer', 'nation')} UNION ALL {_related_sql('supplier', 'customer')}")
_RUN = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "labels", "dirty_orders", "dirty_customer")


def _run_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in _RUN:
        p = api.named(profile_table(_frame(spark, sf_dir, t)), t)
        out = p if out is None else out.union(p)
    return out


_RUN_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, * FROM ({_profile_sql(t)})" for t in _RUN)


def run_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.overview(_run_profiles(spark, sf_dir))


_TABLE_SQL = f"SELECT table_name, count(*) AS fields, max(row_count) AS row_count, count(*) FILTER (potential_enum) AS potential_enums, count(*) FILTER (candidate_primary_key) AS candidate_keys, count(*) FILTER (constant) AS constants FROM ({_RUN_SQL}) GROUP BY table_name"
_query(run_overview, f"SELECT count(*) AS tables, {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('fields', 'row_count', 'potential_enums', 'candidate_keys', 'constants'))} FROM ({_TABLE_SQL})")


def table_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.table_overview(_run_profiles(spark, sf_dir)).drop("schema_name")


_query(table_overview, _TABLE_SQL)


def _percent_sql(x: str) -> str:
    """Two digits of the shortest text of the double, halves away from zero."""
    return f"CAST(round(CAST(CAST(({x}) * 100 AS VARCHAR) AS DECIMAL(38,18)), 2) AS DECIMAL(38,2))::VARCHAR || '%'"


# value_text has v=n parts; a share is of the profiled cells
_VALUES_SQL = f"array_to_string(list_transform(string_split(value_text, '|'), lambda v: array_to_string(string_split(v, '=')[:-2], '=') || '(' || string_split(v, '=')[-1] || ', ' || {_percent_sql("CAST(string_split(v, '=')[-1] AS DOUBLE) / (non_null_count - blank_count - semantic_null_count)")} || ')'), '; ')"


def insight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.insight_rows(_run_profiles(spark, sf_dir)).select("table_name", "name", "insight", "detail")


_query(
    insight_rows,
    f"""WITH p AS ({_RUN_SQL})
SELECT table_name, name, '候选唯一键' AS insight, '非空且唯一率=' || printf('%.2f%%', uniqueness * 100) AS detail FROM p WHERE candidate_primary_key
UNION ALL SELECT table_name, name, '潜在枚举', {_VALUES_SQL} FROM p WHERE potential_enum
UNION ALL SELECT table_name, name, '常量字段', 'Distinct=1, value=' || split_part(value_text, '=', 1) FROM p WHERE constant
UNION ALL SELECT table_name, name, '准常量字段', '值高度集中' FROM p WHERE quasi_constant AND NOT constant""",
)


def enum_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of reports about values, lengths and observations."""
    p = profile_table(_frame(spark, sf_dir, "dirty_orders"))
    flags = [F.col(c) for c in ("potential_enum", "candidate_primary_key", "constant", "quasi_constant", "lob_content_skipped")]
    return p.select("name", texts.value_summary(F.col("values")).alias("values_text"), texts.length_summary(F.col("min_length"), F.col("max_length"), F.col("avg_length")).alias("lengths_text"), texts.insight_summary(*flags).alias("insights_text"))


_query(
    enum_insights,
    f"""WITH p AS ({_profile_sql("dirty_orders")})
SELECT name, CASE WHEN value_text = '' THEN '' ELSE {_VALUES_SQL} END AS values_text,
  CASE WHEN min_length IS NULL THEN '' ELSE min_length || ' / ' || max_length || ' / ' || CAST(round(CAST(CAST(avg_length AS VARCHAR) AS DECIMAL(38,18)), 2) AS DECIMAL(38,2)) END AS lengths_text,
  array_to_string(list_filter([CASE WHEN potential_enum THEN '潜在枚举' END, CASE WHEN candidate_primary_key THEN '候选唯一键' END, CASE WHEN constant THEN '常量字段' END, CASE WHEN quasi_constant AND NOT constant THEN '准常量' END], lambda x: x IS NOT NULL), '；') AS insights_text FROM p""",
)


def type_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, ty.family_of(k)) for k in [*ty.JDBC_FAMILIES, 1111]], "jdbc_type int, family string")


_query(
    type_families,
    """SELECT jdbc_type::INTEGER AS jdbc_type, CASE WHEN jdbc_type IN (1, 12, -1) OR jdbc_type IN (-15, -9, -16) THEN 'STRING' WHEN jdbc_type BETWEEN 2 AND 8 OR jdbc_type IN (-5, -6) THEN 'NUMBER'
  WHEN jdbc_type BETWEEN 91 AND 93 OR jdbc_type IN (2013, 2014) THEN 'DATE_TIME' WHEN jdbc_type IN (16, -7) THEN 'BOOLEAN' WHEN jdbc_type BETWEEN -4 AND -2 THEN 'BINARY' WHEN jdbc_type IN (2004, 2005, 2011) THEN 'LOB' ELSE 'OTHER' END AS family
FROM (SELECT unnest([1, 12, -1, -15, -9, -16, -6, 5, 4, -5, 6, 7, 8, 2, 3, 91, 92, 93, 2013, 2014, 16, -7, -2, -3, -4, 2005, 2011, 2004, 1111]) AS jdbc_type)""",
)


def db_type_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    infos = [(t, i) for t in TABLES for i in column_infos(_frame(spark, sf_dir, t))]
    return spark.createDataFrame([(t, i.name, ty.type_text(i.database_type_name, i.jdbc_type, i.precision, i.scale)) for t, i in infos], "table_name string, name string, type string")


_query(db_type_text, f"SELECT table_name, column_name AS name, data_type AS type FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{t}'" for t in TABLES)})")


def table_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table_list.parse_lines(["﻿# comment", "CUSTOMER", " TEST.ORDERS ", "", "customer", "OTHER.AUDIT_LOG"], "TEST")
    return spark.createDataFrame([(n, r.schema, r.table) for n, r in enumerate(refs)], "nth long, schema_name string, table_name string")


_query(
    table_list_parse,
    """WITH lines AS (SELECT unnest(['# comment', 'CUSTOMER', ' TEST.ORDERS ', '', 'customer', 'OTHER.AUDIT_LOG']) AS line, generate_subscripts(['', '', '', '', '', ''], 1) AS i
), refs AS (SELECT i, CASE WHEN contains(t, '.') THEN split_part(t, '.', 1) ELSE 'TEST' END AS schema_name, CASE WHEN contains(t, '.') THEN split_part(t, '.', 2) ELSE t END AS table_name FROM (SELECT i, trim(line) AS t FROM lines) WHERE t <> '' AND NOT starts_with(t, '#')
), firsts AS (SELECT * FROM refs QUALIFY row_number() OVER (PARTITION BY upper(schema_name), upper(table_name) ORDER BY i) = 1)
SELECT row_number() OVER (ORDER BY i) - 1 AS nth, schema_name, table_name FROM firsts""",
)
