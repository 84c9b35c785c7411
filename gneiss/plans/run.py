"""A run over a list of tables: each is profiled, stored as it completes, and reported at the end."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.profile import profile_table
from ..options import ProfileOptions
from ..sinks.html import write_html
from ..sinks.store import RunStore, table_record
from ..sinks.xlsx import write_xlsx
from ..sources.tables import TableRef, from_catalog, safe_name

WORKBOOK = "quality-profile.xlsx"
_MESSAGE_MOST = 1000


def _now() -> int:
    return int(time.time() * 1000)


def run_id(at: datetime | None = None) -> str:
    at = at or datetime.now()
    return at.strftime("%Y%m%d_%H%M%S_") + f"{at.microsecond // 1000:03d}"


def generate_reports(directory: str) -> None:
    """Workbook and pages of a run directory, from its records alone; may be repeated at any time."""
    store = RunStore(directory)
    manifest, records = store.read_manifest(), store.read_tables()
    write_xlsx(str(Path(directory) / WORKBOOK), manifest, records)
    write_html(directory, manifest, records)


def run(
    spark: SparkSession, database: str, tables: list[TableRef], output_root: str, options: ProfileOptions | None = None,
    reader: Callable[[SparkSession, TableRef], DataFrame] | None = None, primary_keys: Callable[[TableRef], tuple[str, ...]] | None = None,
    lobs: Callable[[TableRef], dict[str, str]] | None = None,
) -> str:
    """The run's directory. A table that fails, a bad name included, is recorded and the rest go on; if all fail the first error is raised after reports are written."""
    options, reader = options or ProfileOptions(), reader or from_catalog
    directory = str(Path(output_root) / run_id())
    store = RunStore(directory)
    manifest = {
        "runId": Path(directory).name, "database": database, "status": "RUNNING", "startedAtEpochMillis": _now(), "finishedAtEpochMillis": 0, "totalTables": len(tables),
        "successTables": 0, "failedTables": 0, "options": options.snapshot(), "tables": [],
    }
    store.write_manifest(manifest)
    first_error: Exception | None = None
    for ref in tables:
        entry, began = {"schema": ref.schema, "table": ref.table}, _now()
        try:
            safe_name(ref.schema, ref.table)
            rows = profile_table(reader(spark, ref), options, primary_keys(ref) if primary_keys else (), lobs(ref) if lobs else None).collect()
            path = store.write_table(table_record(database, ref.schema, ref.table, rows, began, _now() - began))
            entry |= {"status": "SUCCESS", "rowCount": rows[0]["row_count"] if rows else 0, "recordFile": f"tables/{path.name}"}
            manifest["successTables"] += 1
        except Exception as e:  # noqa: BLE001  one table's failure is its own
            first_error = first_error or e
            entry |= {"status": "FAILED", "errorMessage": str(e)[:_MESSAGE_MOST]}
            manifest["failedTables"] += 1
        manifest["tables"].append(entry | {"durationMillis": _now() - began})
        store.write_manifest(manifest)
    manifest |= {"status": "COMPLETED_WITH_ERRORS" if manifest["failedTables"] else "COMPLETED", "finishedAtEpochMillis": _now()}
    store.write_manifest(manifest)
    generate_reports(directory)
    if first_error and not manifest["successTables"]:
        raise first_error
    return directory
