"""From a wide table to one row per distinct (column, value), in one scan and one shuffle.

Cells are exploded with their column's ordinal and counted by native value; equal cells meet
within each task before the shuffle, so frequent values, nulls included, move as one row per
task. Numbers and times get their canonical text afterwards, once for each distinct value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import canonical as cn
from ..functions import types as ty
from ..options import ProfileOptions


@dataclass(frozen=True)
class ColumnInfo:
    ordinal: int
    name: str
    label: str
    jdbc_type: int
    database_type_name: str
    precision: int
    scale: int
    nullable: bool
    declared_primary_key: bool
    family: str
    kind: T.DataType
    preview: str | None = None

    @property
    def is_lob(self) -> bool:
        return self.family == ty.LOB

    @property
    def ranged(self) -> str | None:
        """The native field that holds the column's values, if they compare other than as text."""
        if self.is_lob:
            return None
        if isinstance(self.kind, T.FloatType | T.DoubleType):
            return "real"
        if isinstance(self.kind, T.IntegralType):
            return "whole"
        return "time" if isinstance(self.kind, T.DateType | T.TimestampType | T.TimestampNTZType) else None


def column_infos(df: DataFrame, primary_keys: tuple[str, ...] = (), lobs: dict[str, str] | None = None) -> list[ColumnInfo]:
    """The columns of a table; primary keys and LOB columns (name -> CLOB or BLOB) are the caller's to name, in any case.

    A column whose metadata says ``preview_of`` is the beginning of that LOB, not a column of the table.
    """
    keys = {k.upper() for k in primary_keys}
    lobs = {k.upper(): v for k, v in (lobs or {}).items()}
    out = []
    previews = {f.metadata["preview_of"]: f.name for f in df.schema.fields if "preview_of" in f.metadata}
    for i, f in enumerate(f for f in df.schema.fields if "preview_of" not in f.metadata):
        field = T.StructField(f.name, f.dataType, f.nullable, f.metadata | ({"lob": lobs[f.name.upper()]} if f.name.upper() in lobs else {}))
        out.append(ColumnInfo(i + 1, f.name, f.metadata.get("label", f.name), nullable=f.nullable, declared_primary_key=f.name.upper() in keys, kind=f.dataType, preview=previews.get(f.name), **ty.describe(field)))
    return out


_NATIVE = {"whole": "bigint", "real": "double", "time": "timestamp_ntz"}
#: Fields that identify a distinct cell; a table carries only those that some column of it needs.
_KEYS = {"text": "string", "preview": "string"} | _NATIVE
_NULL, _BLANK, _SEMANTIC = 1, 2, 3


def _cell(info: ColumnInfo, options: ProfileOptions) -> dict[str, Column | None]:
    """The fields of a column's cell; None where the column has nothing to say."""
    c = F.col(f"`{info.name}`")
    text = isinstance(info.kind, T.StringType)
    value = blank = semantic = changed = length = preview = None
    native = dict.fromkeys(_NATIVE)
    if info.is_lob:
        held = c.isNotNull()
        # a number in place of a large object is its length, computed where the object is
        length = c if isinstance(info.kind, T.IntegralType) else F.when(held, cn.utf16_length(c) if text else F.octet_length(c))
        start = F.col(f"`{info.preview}`") if info.preview else c if text else None
        if options.pattern_profile_enabled and options.clob_preview_chars and start is not None:
            preview = F.when(held & (start != ""), F.substring(start, 1, options.clob_preview_chars))
    elif text:
        trimmed = cn.trim(c) if options.trim_strings else c
        blank = trimmed == ""
        semantic = ~blank & cn.is_semantic_null(c, options.semantic_null_tokens)
        changed = c != trimmed
        held = ~blank & ~semantic
        value, length = F.when(held, trimmed), F.when(held, cn.utf16_length(c))
    elif info.ranged and not (options.distinct_enabled or options.range_enabled):
        value = F.when(c.isNotNull(), F.lit(""))  # only whether there is one counts
    elif info.ranged:
        # a float is the number its text says, not the nearest double of its bits
        native[info.ranged] = c.cast("string").cast("double") if isinstance(info.kind, T.FloatType) else c
    else:
        value = cn.canonical(c, info.kind, options.trim_strings)
        length = F.octet_length(c) if isinstance(info.kind, T.BinaryType) else None
    if not (options.distinct_enabled or options.pattern_profile_enabled or options.string_shape_enabled or options.case_variant_tracking_enabled) and value is not None:
        value = F.when(value.isNotNull(), F.lit(""))
    state = F.when(c.isNull(), _NULL)
    if text and not info.is_lob:
        state = state.when(blank, _BLANK).when(semantic, _SEMANTIC)
    return {"state": state.otherwise(0), "text": value, "preview": preview, **native, "trimmed": None if changed is None else F.when(changed, 1).otherwise(0), "len": length if options.length_enabled else None}


def value_counts(df: DataFrame, infos: list[ColumnInfo], options: ProfileOptions) -> DataFrame:
    """A row for each distinct cell of a column, by its native value, with n and what those cells add up to."""
    fields = {i.ordinal: _cell(i, options) for i in infos}
    kinds = {"state": "int", **_KEYS, "trimmed": "int", "len": "bigint"}
    used = {k: t for k, t in kinds.items() if any(f[k] is not None for f in fields.values())}
    cells = [F.struct(F.lit(o).alias("ordinal"), *[(F.lit(None) if f[k] is None else f[k]).cast(t).alias(k) for k, t in used.items()]) for o, f in fields.items()]
    rows = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    sums = [F.sum("trimmed").cast("long").alias("trimmed_n")] if "trimmed" in used else []
    if "len" in used:
        sums += [F.count("len").alias("len_n"), F.sum("len").alias("len_sum"), F.min("len").alias("len_min"), F.max("len").alias("len_max")]
    out = rows.groupBy("ordinal", "state", *[k for k in _KEYS if k in used]).agg(F.count("*").alias("n"), *sums)
    absent = lambda k, t: F.col(k) if k in out.columns else F.lit(None).cast(t).alias(k)
    of = lambda state, name: F.when(F.col("state") == state, F.col("n")).otherwise(0).alias(name)
    return out.select(
        "ordinal", *[absent(k, t) for k, t in _KEYS.items()], "n", of(_NULL, "nulls"), of(_BLANK, "blanks"), of(_SEMANTIC, "semantic"), F.coalesce(absent("trimmed_n", "long"), F.lit(0)).alias("trimmed"),
        F.coalesce(absent("len_n", "long"), F.lit(0)).alias("len_n"), *[absent(k, "long") for k in ("len_sum", "len_min", "len_max")],
    )


def is_profiled() -> Column:
    return F.col("text").isNotNull() | F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("time").isNotNull()


def time_text(time: Column, infos: list[ColumnInfo]) -> Column:
    dates = [i.ordinal for i in infos if isinstance(i.kind, T.DateType)]
    return F.when(F.col("ordinal").isin(dates), time.cast("date").cast("string")).otherwise(cn.timestamp_text(time))


def with_values(counts: DataFrame, infos: list[ColumnInfo]) -> DataFrame:
    """The profiled rows with their canonical text as ``value``."""
    text = F.coalesce("text", F.col("whole").cast("string"), cn.double_text(F.col("real")), time_text(F.col("time"), infos))
    return counts.filter(is_profiled()).withColumn("value", text)
