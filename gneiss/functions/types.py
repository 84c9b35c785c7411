"""Families of types, and how a type is written."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, NUMBER, DATE_TIME, BOOLEAN, BINARY, LOB, OTHER = "STRING", "NUMBER", "DATE_TIME", "BOOLEAN", "BINARY", "LOB", "OTHER"

# Type codes of java.sql.Types.
JDBC_FAMILIES = {
    1: STRING, 12: STRING, -1: STRING, -15: STRING, -9: STRING, -16: STRING,
    -6: NUMBER, 5: NUMBER, 4: NUMBER, -5: NUMBER, 6: NUMBER, 7: NUMBER, 8: NUMBER, 2: NUMBER, 3: NUMBER,
    91: DATE_TIME, 92: DATE_TIME, 93: DATE_TIME, 2013: DATE_TIME, 2014: DATE_TIME,
    16: BOOLEAN, -7: BOOLEAN,
    -2: BINARY, -3: BINARY, -4: BINARY,
    2005: LOB, 2011: LOB, 2004: LOB,
}
#: Codes of types written with their length, and of those written with precision and scale.
SIZED = {1, 12, -1, -15, -9, -16, -2, -3, -4}
EXACT = {3, 2}
_SPARK = {
    T.StringType: (12, "VARCHAR"), T.ByteType: (-6, "TINYINT"), T.ShortType: (5, "SMALLINT"), T.IntegerType: (4, "INTEGER"), T.LongType: (-5, "BIGINT"),
    T.FloatType: (7, "REAL"), T.DoubleType: (8, "DOUBLE"), T.DecimalType: (3, "DECIMAL"), T.DateType: (91, "DATE"), T.TimestampType: (2014, "TIMESTAMP WITH TIME ZONE"),
    T.TimestampNTZType: (93, "TIMESTAMP"), T.BooleanType: (16, "BOOLEAN"), T.BinaryType: (-3, "VARBINARY"),
}


if hasattr(T, "TimeType"):  # Spark 4.1 and later
    _SPARK[T.TimeType] = (92, "TIME")


def is_time_of_day(kind: T.DataType) -> bool:
    return hasattr(T, "TimeType") and isinstance(kind, T.TimeType)


def family_of(jdbc_type: int) -> str:
    return JDBC_FAMILIES.get(jdbc_type, OTHER)


def describe(field: T.StructField) -> dict:
    """jdbc_type, database_type_name, precision, scale and family; metadata may override the first four and tag ``lob`` as CLOB or BLOB."""
    kind = field.dataType
    code, name = next((v for k, v in _SPARK.items() if isinstance(kind, k)), (1111, kind.simpleString().upper()))
    size = (kind.precision, kind.scale) if isinstance(kind, T.DecimalType) else (getattr(kind, "length", 0) or 0, 0)
    if lob := field.metadata.get("lob"):
        code, name, size = {"CLOB": 2005, "NCLOB": 2011, "BLOB": 2004}[lob], lob, (0, 0)
    out = {"jdbc_type": code, "database_type_name": name, "precision": size[0], "scale": size[1]}
    out |= {k: field.metadata[k] for k in out if k in field.metadata}
    return out | {"family": LOB if lob else family_of(code)}


def type_text(name: str | None, jdbc_type: int, precision: int, scale: int) -> str:
    """VARCHAR(100), DECIMAL(18,2), or the bare name where no size belongs."""
    if name and precision > 0 and jdbc_type in SIZED:
        return f"{name}({precision})"
    if name and precision > 0 and jdbc_type in EXACT:
        return f"{name}({precision},{max(scale, 0)})"
    return name or ""
