"""The library's front: profiles of tables, runs, relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.profile import find_column, insight_rows, overview, profile_table, table_overview
from .operators.relations import relationships, set_overlap
from .options import ProfileOptions
from .plans.run import generate_reports, run
from .sources.tables import JdbcSource, TableRef, from_catalog

__all__ = [
    "JdbcSource", "ProfileOptions", "RowFeed", "TableRef", "find_column", "generate_reports", "insight_rows", "named", "overview", "profile_table", "profile_tables",
    "relationships", "run", "set_overlap", "table_overview",
]


def named(profile: DataFrame, table: str, schema: str = "") -> DataFrame:
    """A profile with its table's name, as overviews and relationships want it."""
    return profile.select(F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name"), *profile.columns)


def profile_tables(spark: SparkSession, refs: list[TableRef], options: ProfileOptions | None = None, reader=from_catalog) -> DataFrame:
    """Named profiles of all tables; the first failure is raised."""
    profiles = [named(profile_table(reader(spark, r), options), r.table, r.schema) for r in refs]
    out = profiles[0]
    for p in profiles[1:]:
        out = out.unionByName(p)
    return out


class RowFeed:
    """Rows handed over cell by cell or whole, then profiled: the in-memory source."""

    def __init__(self, spark: SparkSession, schema, options: ProfileOptions | None = None):
        self.spark, self.options, self.done = spark, options, False
        self.schema = spark.createDataFrame([], schema).schema
        self.rows: list[tuple] = []
        self.row: list | None = None

    def begin_row(self) -> None:
        self._open()
        if self.row is not None:
            raise RuntimeError("a row is open already")
        self.row = []

    def accept_cell(self, value) -> None:
        if self.row is None:
            raise RuntimeError("no row is open")
        if len(self.row) == len(self.schema):
            raise RuntimeError("the row has all its cells")
        self.row.append(value)

    def end_row(self) -> None:
        if self.row is None or len(self.row) != len(self.schema):
            raise RuntimeError("the row is not complete")
        self.rows.append(tuple(self.row))
        self.row = None

    def accept_row(self, *values) -> None:
        self.begin_row()
        for v in values:
            self.accept_cell(v)
        self.end_row()

    def finish(self, **kw) -> DataFrame:
        self._open()
        if self.row is not None:
            raise RuntimeError("a row is still open")
        self.done = True
        return profile_table(self.spark.createDataFrame(self.rows, self.schema), self.options, **kw)

    def _open(self) -> None:
        if self.done:
            raise RuntimeError("finished already")
