"""The profile of a table: one row per column."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from ..functions import canonical as cn
from ..functions import texts
from ..functions import types as ty
from ..options import ProfileOptions
from ..plans.longform import ColumnInfo, column_infos, is_profiled, time_text, value_counts, with_values

#: A column of so few distinct values may be an enumeration, whatever the options.
ENUM_MOST = 20
QUASI_SHARE = 0.99

_VALUE = "array<struct<value:string,count:bigint,ratio:double>>"
_PATTERN = "array<struct<pattern:string,count:bigint>>"
_SHAPE = f"struct<{','.join(f'{s}:bigint' for s in cn.SHAPES)}>"
_FINGERPRINT = "struct<distinct_count:bigint,hash_sum:decimal(38,0),hash_xor:bigint,second_hash_sum:decimal(38,0),min_hash_bins:array<bigint>>"
SCHEMA = (
    "ordinal int, name string, label string, jdbc_type int, database_type_name string, precision int, scale int, nullable boolean, declared_primary_key boolean, family string, "
    "row_count bigint, null_count bigint, null_rate double, blank_count bigint, semantic_null_count bigint, non_null_count bigint, distinct_count bigint, uniqueness double, "
    "min_value string, max_value string, min_length bigint, max_length bigint, avg_length double, trim_changed_count bigint, case_variant_group_count int, "
    "candidate_primary_key boolean, constant boolean, quasi_constant boolean, low_cardinality boolean, potential_enum boolean, lob_content_skipped boolean, "
    f"values {_VALUE}, patterns {_PATTERN}, shape {_SHAPE}, fingerprint {_FINGERPRINT}"
)


def _sums(counts: DataFrame, infos: list[ColumnInfo], options: ProfileOptions) -> DataFrame:
    """A row per column: sums of its cells, and its extremes as canonical texts."""
    held = is_profiled()
    finite = F.when(~F.isnan("real") & (F.abs("real") != float("inf")), F.col("real"))
    native = {"whole": F.col("whole"), "real": finite, "time": F.col("time")}
    # decimals compare as their own type: no other type holds all digits of two of them
    exact = {f"exact_{k.precision}_{k.scale}": k for k in {i.kind for i in infos if isinstance(i.kind, T.DecimalType)}}
    of = lambda wanted: F.when(F.col("ordinal").isin([i.ordinal for i in infos if wanted(i.kind)]), F.col("text"))
    native |= {name: of(lambda x, k=k: x == k).try_cast(k) for name, k in exact.items()}
    # texts of times of day are in order
    native["clock"] = of(ty.is_time_of_day)
    df = counts.groupBy("ordinal").agg(
        F.sum("n").alias("rows"), *[F.sum(c).alias(c) for c in ("nulls", "blanks", "semantic", "trimmed", "len_n", "len_sum")], F.min("len_min").alias("len_min"), F.max("len_max").alias("len_max"),
        F.count_if(held).alias("distinct"), F.coalesce(F.sum(F.when(held, F.col("n"))), F.lit(0)).alias("profiled"),
        *[f(x).alias(f"{k}_{side}") for k, x in native.items() for side, f in (("min", F.min), ("max", F.max))],
    )
    for side in ("min", "max"):
        text = F.coalesce(F.col(f"whole_{side}").cast("string"), cn.double_text(F.col(f"real_{side}")), time_text(F.col(f"time_{side}"), infos), F.col(f"clock_{side}"), *[cn.strip_zeros(F.col(f"{name}_{side}").cast("string")) for name in sorted(exact)])
        df = df.withColumn(f"{side}_value", text if options.range_enabled else F.lit(None).cast("string"))
    return df


def top_values(counts: DataFrame, sums: DataFrame, options: ProfileOptions) -> DataFrame:
    """ordinal, values: of columns within the tracking limit, all values up to the enum threshold, else the most frequent."""
    few = sums.filter(F.col("distinct").between(1, options.low_cardinality_tracking_limit)).select(F.col("ordinal").alias("o"), "distinct", "profiled")
    rows = counts.select("ordinal", "value", "n").join(F.broadcast(few), F.col("ordinal") == F.col("o"))
    nth = F.row_number().over(W.partitionBy("ordinal").orderBy(F.desc("n"), "value"))
    most = F.when(F.col("distinct") <= options.enum_print_threshold, F.col("distinct")).otherwise(options.top_value_limit)
    rows = rows.withColumn("nth", nth).filter(F.col("nth") <= most)
    one = F.struct("nth", F.struct("value", F.col("n").alias("count"), (F.col("n") / F.col("profiled")).alias("ratio")).alias("v"))
    return rows.groupBy("ordinal").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["v"]).cast(_VALUE).alias("values"))


def top_patterns(counts: DataFrame, options: ProfileOptions, strings: list[int]) -> DataFrame:
    """ordinal, patterns: the most frequent, ties by pattern; beyond ``pattern_limit`` of a column pooled as OTHER."""
    source = F.when(F.col("ordinal").isin(strings), F.col("text")).otherwise(F.col("preview"))
    rows = counts.select("ordinal", source.alias("text"), "n").filter("text IS NOT NULL").groupBy("ordinal", cn.pattern(F.col("text")).alias("pattern")).agg(F.sum("n").alias("n"))
    # a task ranks only what can matter: the first of each salt, the rest already pooled with it
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("pattern"), F.lit(32)))
    order = [F.desc("n"), "pattern"]
    near = salted.withColumn("nth", F.row_number().over(W.partitionBy("ordinal", "salt").orderBy(*order)))
    near = near.withColumn("pattern", F.when(F.col("nth") <= options.pattern_limit, F.col("pattern"))).groupBy("ordinal", "pattern").agg(F.sum("n").alias("n"))
    known = near.withColumn("nth", F.row_number().over(W.partitionBy("ordinal").orderBy(F.col("pattern").isNull(), *order)))
    name = F.when(F.col("pattern").isNotNull() & (F.col("nth") <= options.pattern_limit), F.col("pattern")).otherwise("OTHER")
    pooled = known.groupBy("ordinal", name.alias("pattern")).agg(F.sum("n").alias("count"))
    best = pooled.withColumn("nth", F.row_number().over(W.partitionBy("ordinal").orderBy(F.desc("count"), "pattern"))).filter(F.col("nth") <= options.top_value_limit)
    return best.groupBy("ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.struct("pattern", "count").alias("p")))), lambda x: x["p"]).cast(_PATTERN).alias("patterns"))


def shape_counts(counts: DataFrame, strings: list[int]) -> DataFrame:
    rows = counts.filter(F.col("ordinal").isin(strings))
    rows = rows.withColumns(cn.shapes(F.col("value")))
    return rows.groupBy("ordinal").agg(F.struct(*[F.sum(F.when(F.col(s), F.col("n")).otherwise(0)).alias(s) for s in cn.SHAPES]).cast(_SHAPE).alias("shape"))


def case_variants(counts: DataFrame, strings: list[int], limit: int) -> DataFrame:
    """ordinal, case_variant_group_count: groups of several spellings; 0 with more groups than the limit."""
    rows = counts.filter(F.col("ordinal").isin(strings))
    folded = rows.groupBy("ordinal", F.lower("value").alias("folded")).agg(F.count("*").alias("spellings"))
    several = F.sum(F.when(F.col("spellings") > 1, 1).otherwise(0))
    return folded.groupBy("ordinal").agg(F.when(F.count("*") > limit, 0).otherwise(several).cast("int").alias("case_variant_group_count"))


def set_fingerprints(counts: DataFrame, bins: int) -> DataFrame:
    """ordinal, fingerprint of the set of values: count, sum, xor and second sum of hashes, and the least rank in each bin."""
    rows = counts.select("ordinal", cn.hash60(F.col("value")).alias("h"), cn.hash60(F.col("value"), "#").alias("h2"))
    whole = rows.groupBy("ordinal").agg(F.count("*").alias("c"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x"), F.sum(F.col("h2").cast("decimal(38,0)")).alias("s2"))
    least = rows.groupBy("ordinal", (F.col("h") % bins).alias("bin")).agg(F.min(F.expr(f"h div {int(bins)}")).alias("rank"))
    least = least.groupBy(F.col("ordinal").alias("o")).agg(F.map_from_entries(F.collect_list(F.struct("bin", "rank"))).alias("ranks"))
    table = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at(F.col("ranks"), b.cast("long")), F.lit((1 << 63) - 1)))
    joined = whole.join(least, F.col("ordinal") == F.col("o"))
    return joined.select("ordinal", F.struct(F.col("c").alias("distinct_count"), F.col("s").alias("hash_sum"), F.col("x").alias("hash_xor"), F.col("s2").alias("second_hash_sum"), table.alias("min_hash_bins")).cast(_FINGERPRINT).alias("fingerprint"))


def profile_table(df: DataFrame, options: ProfileOptions | None = None, primary_keys: tuple[str, ...] = (), lobs: dict[str, str] | None = None) -> DataFrame:
    """A row per column of ``df`` with the columns of SCHEMA. The table is scanned once, here; the result is small and local.

    An empty table gives a row per column with zero counts.
    """
    options = options or ProfileOptions()
    infos = column_infos(df, primary_keys, lobs)
    spark = df.sparkSession
    strings = [i.ordinal for i in infos if isinstance(i.kind, T.StringType) and not i.is_lob]
    counts = value_counts(df, infos, options).persist(StorageLevel.MEMORY_AND_DISK)
    values = with_values(counts, infos)
    try:
        sums = _sums(counts, infos, options)
        # each of these is bounded by the number of columns times a limit of the options
        known = {r["ordinal"]: r.asDict() for r in sums.collect()}
        extra: dict[int, dict] = {i.ordinal: {} for i in infos}
        wanted = []
        if options.value_frequency_enabled and any(0 < r["distinct"] <= options.low_cardinality_tracking_limit for r in known.values()):
            local = spark.createDataFrame([(o, r["distinct"], r["profiled"]) for o, r in known.items()], "ordinal int, distinct long, profiled long")
            wanted.append(top_values(values, local, options))
        if options.pattern_profile_enabled:
            wanted.append(top_patterns(counts, options, strings))
        if options.string_shape_enabled and strings:
            wanted.append(shape_counts(values, strings))
        if options.case_variant_tracking_enabled and strings:
            wanted.append(case_variants(values, strings, options.low_cardinality_tracking_limit))
        if options.relationship_fingerprint_enabled:
            wanted.append(set_fingerprints(values, options.min_hash_bins))
        for frame in wanted:
            for r in frame.collect():
                extra[r["ordinal"]] |= r.asDict()
    finally:
        counts.unpersist()
    return spark.createDataFrame([_record(i, known.get(i.ordinal), extra[i.ordinal], options) for i in infos], SCHEMA)


def _record(info: ColumnInfo, sums: dict | None, extra: dict, options: ProfileOptions) -> tuple:
    sums = sums or dict.fromkeys(("rows", "nulls", "blanks", "semantic", "trimmed", "len_n", "distinct", "profiled"), 0) | dict.fromkeys(("len_sum", "len_min", "len_max", "min_value", "max_value"))
    rows, nulls, profiled = sums["rows"], sums["nulls"], sums["profiled"]
    distinct = sums["distinct"] if options.distinct_enabled else 0
    skipped = info.is_lob and rows > nulls
    values = extra.get("values") or []
    tracked = options.value_frequency_enabled and sums["distinct"] <= options.low_cardinality_tracking_limit
    candidate = options.distinct_enabled and not skipped and rows > 0 and not (nulls or sums["blanks"] or sums["semantic"]) and distinct == rows
    none = (0, Decimal(0), 0, Decimal(0), [])
    return (
        info.ordinal, info.name, info.label, info.jdbc_type, info.database_type_name, info.precision, info.scale, info.nullable, info.declared_primary_key, info.family,
        rows, nulls, nulls / rows if rows else 0.0, sums["blanks"], sums["semantic"], rows - nulls, distinct, distinct / profiled if profiled else 0.0,
        sums["min_value"], sums["max_value"], sums["len_min"], sums["len_max"], sums["len_sum"] / sums["len_n"] if sums["len_n"] else None, sums["trimmed"], extra.get("case_variant_group_count", 0) or 0,
        candidate, options.distinct_enabled and distinct == 1 and profiled > 0, bool(values) and values[0]["ratio"] >= QUASI_SHARE, options.distinct_enabled and tracked,
        info.family != ty.LOB and 0 < distinct <= ENUM_MOST, skipped, values, extra.get("patterns") or [], extra.get("shape") or (0,) * len(cn.SHAPES), extra.get("fingerprint") or none,
    )


def find_column(profile: DataFrame, name: str) -> DataFrame:
    """The column of that name, in any case."""
    return profile.filter(F.lower("name") == name.lower())


def overview(profiles: DataFrame) -> DataFrame:
    """Totals of a run; ``profiles`` has schema_name and table_name beside the columns of a profile."""
    sum_of = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return table_overview(profiles).agg(F.count("*").alias("tables"), *[sum_of(c) for c in ("fields", "row_count", "potential_enums", "candidate_keys", "constants")])


def table_overview(profiles: DataFrame) -> DataFrame:
    flag = lambda c, name: F.sum(F.col(c).cast("int")).cast("long").alias(name)
    return profiles.groupBy("schema_name", "table_name").agg(
        F.count("*").alias("fields"), F.max("row_count").alias("row_count"), flag("potential_enum", "potential_enums"), flag("candidate_primary_key", "candidate_keys"), flag("constant", "constants"),
    )


def insight_rows(profiles: DataFrame) -> DataFrame:
    """A row for each observation of a column: schema_name, table_name, name, insight, detail."""
    first = F.get(F.col("values"), 0)["value"]
    say = lambda when, insight, detail: F.when(when, F.struct(F.lit(insight).alias("insight"), detail.alias("detail")))
    found = F.array(
        say(F.col("potential_enum"), texts.ENUM, texts.value_summary(F.col("values"))),
        say(F.col("candidate_primary_key"), texts.KEY, F.concat(F.lit("非空且唯一率="), texts.percent(F.col("uniqueness")))),
        say(F.col("constant"), texts.CONSTANT, F.concat(F.lit("Distinct=1"), F.when(first.isNull(), "").otherwise(F.concat(F.lit(", value="), first)))),
        say(F.col("quasi_constant") & ~F.col("constant"), "准常量字段", F.lit("值高度集中")),
    )
    rows = profiles.select("schema_name", "table_name", "ordinal", "name", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"))
    return rows.select("schema_name", "table_name", "ordinal", "name", "x.insight", "x.detail")
