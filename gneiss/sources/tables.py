"""Where tables come from: files, the catalog, rows in memory, and databases by JDBC."""

from __future__ import annotations

import logging
import re
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import ProfileOptions

_LOG = logging.getLogger(__name__)
# Type codes of large objects.
LOB_KINDS = {2005: "CLOB", 2011: "NCLOB", 2004: "BLOB"}
_SAFE = re.compile(r"[A-Za-z0-9_$#]+")


@dataclass(frozen=True)
class TableRef:
    schema: str
    table: str

    @property
    def display(self) -> str:
        return f"{self.schema}.{self.table}" if self.schema else self.table


def safe_name(schema: str | None, table: str) -> str:
    """``schema.table`` or the bare table; only letters, digits, _ $ # may occur."""
    parts = [p for p in ((schema or "").strip(), (table or "").strip() if table else table) if p]
    if not table or not table.strip() or not all(_SAFE.fullmatch(p) for p in parts):
        raise ValueError(f"unsafe identifier: {schema!r}, {table!r}")
    return ".".join(parts)


def scan_sql(schema: str | None, table: str) -> str:
    return f"SELECT * FROM {safe_name(schema, table)}"


def from_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def from_catalog(spark: SparkSession, ref: TableRef) -> DataFrame:
    return spark.read.table(safe_name(ref.schema, ref.table))


def from_rows(spark: SparkSession, rows: list, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@dataclass(frozen=True)
class JdbcSource:
    """A database. Of LOB columns lengths, and a preview if asked for, are computed there, and bodies never travel.

    Which columns are LOBs the driver's metadata says, unless the caller does.
    """

    url: str
    driver: str | None = None
    user: str | None = None
    password: str | None = None
    length_function: str = "LENGTH"
    substring_function: str = "SUBSTR"
    partition_column: str | None = None
    bounds: tuple[int, int] | None = None
    partitions: int = 1

    def options(self, ref: TableRef, profile: ProfileOptions, columns: list[str] | None = None, lobs: dict[str, str] | None = None) -> dict[str, str]:
        source = safe_name(ref.schema, ref.table)
        if lobs and columns:
            parts = []
            for c in columns:
                safe_name(None, c)
                if c in lobs:
                    parts.append(f"{self.length_function}({c}) AS {c}")
                    if lobs[c] != "BLOB" and profile.clob_preview_chars:
                        parts.append(f"{self.substring_function}({c}, 1, {profile.clob_preview_chars}) AS {c}_PREVIEW")
                else:
                    parts.append(c)
            source = f"(SELECT {', '.join(parts)} FROM {source}) t"
        out = {"url": self.url, "dbtable": source, "fetchsize": str(profile.fetch_size)}
        if profile.query_timeout_seconds > 0:
            out["queryTimeout"] = str(profile.query_timeout_seconds)
        out |= {k: v for k, v in (("driver", self.driver), ("user", self.user), ("password", self.password)) if v}
        if self.partition_column and self.bounds:
            out |= {"partitionColumn": self.partition_column, "lowerBound": str(self.bounds[0]), "upperBound": str(self.bounds[1]), "numPartitions": str(self.partitions)}
        return out

    def read(self, spark: SparkSession, ref: TableRef, profile: ProfileOptions, columns: list[str] | None = None, lobs: dict[str, str] | None = None) -> DataFrame:
        """The table; LOB columns hold their lengths and carry their kind in the metadata, and previews say what they are of."""
        if columns is None:
            types = self.column_types(spark, ref)
            columns = list(types)
            lobs = {c: LOB_KINDS[t] for c, t in types.items() if t in LOB_KINDS} if lobs is None else lobs
        df = spark.read.format("jdbc").options(**self.options(ref, profile, columns, lobs)).load()
        real = {c.upper(): c for c in df.columns}
        for c, kind in (lobs or {}).items():
            df = df.withMetadata(real[c.upper()], {"lob": kind})
            if (preview := real.get(f"{c}_PREVIEW".upper())) and kind != "BLOB" and profile.clob_preview_chars:
                df = df.withMetadata(preview, {"preview_of": real[c.upper()]})
        return df

    @contextmanager
    def _metadata(self, spark: SparkSession):
        """(connection, its metadata), by the named driver; the class loader of Spark's jars finds it."""
        jvm = spark.sparkContext._jvm
        props = jvm.java.util.Properties()
        for k, v in (("user", self.user), ("password", self.password)):
            if v:
                props.setProperty(k, v)
        if self.driver:
            loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
            connection = loader.loadClass(self.driver).getDeclaredConstructors()[0].newInstance(spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 0)).connect(self.url, props)
        else:
            connection = jvm.java.sql.DriverManager.getConnection(self.url, props)
        try:
            yield connection, connection.getMetaData()
        finally:
            connection.close()

    def column_types(self, spark: SparkSession, ref: TableRef) -> dict[str, int]:
        """Names of columns in order, with the codes of their types: metadata of an empty result, no rows are read."""
        with self._metadata(spark) as (connection, _):
            found = connection.createStatement().executeQuery(f"{scan_sql(ref.schema, ref.table)} WHERE 1 = 0").getMetaData()
            return {found.getColumnName(i): found.getColumnType(i) for i in range(1, found.getColumnCount() + 1)}

    def primary_keys(self, spark: SparkSession, ref: TableRef) -> tuple[str, ...]:
        """By the driver's metadata. Keys are optional: a driver's failure is logged, and there are none."""
        try:
            with self._metadata(spark) as (_, meta):
                found, out = meta.getPrimaryKeys(None, ref.schema or None, ref.table), []
                while found.next():
                    out.append(found.getString("COLUMN_NAME").upper())
                return tuple(out)
        except Py4JError as e:
            _LOG.warning("no primary keys of %s: %s", ref.display, e)
            return ()


def lob_stats(df: DataFrame, column: str, binary: bool = False, preview: int = 0) -> DataFrame:
    """kind, length, preview of each value of a large column; the body is dropped at the scan's projection."""
    c = F.col(column)
    length = F.octet_length(c) if binary else F.length(c)
    text = F.substring(c, 1, preview) if preview and not binary else F.lit(None).cast("string")
    return df.select(F.lit("BLOB" if binary else "CLOB").alias("kind"), length.cast("long").alias("length"), text.alias("preview"))
