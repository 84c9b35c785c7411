"""Records of a run: a JSON file per table as it completes, and a manifest; read back for reports."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from ..options import camel


def file_part(text: str | None, empty: str) -> str:
    text = (text or "").strip() or empty
    return re.sub(r"[^A-Za-z0-9_.-]", "_", text)


def file_name(schema: str | None, table: str | None) -> str:
    return f"{file_part(schema, 'DEFAULT')}.{file_part(table, 'UNKNOWN')}.json"


def camelled(x):
    """Names in camel case, absent values left out."""
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return {camel(k): camelled(v) for k, v in x.items() if v is not None}
    return [camelled(v) for v in x] if isinstance(x, list | tuple) else x


def table_record(database: str, schema: str, table: str, rows: list, scanned_at: int, duration: int) -> dict:
    """The persisted form of a profile; fingerprints are not kept."""
    columns = []
    for r in sorted(rows, key=lambda r: r["ordinal"]):
        record = r.asDict()
        record.pop("fingerprint", None)
        columns.append(camelled(record))
    return {"database": database, "schema": schema, "table": table, "scannedAtEpochMillis": scanned_at, "durationMillis": duration, "rowCount": rows[0]["row_count"] if rows else 0, "columns": columns}


class RunStore:
    def __init__(self, directory: str):
        self.directory = Path(directory)
        (self.directory / "tables").mkdir(parents=True, exist_ok=True)
        self.written: dict[str, tuple[str, str]] = {}

    def _write(self, path: Path, data: dict) -> None:
        part = path.with_name(path.name + ".tmp")
        part.write_text(json.dumps(data, ensure_ascii=False, indent=2), encoding="utf-8")
        os.replace(part, path)

    def write_manifest(self, manifest: dict) -> None:
        self._write(self.directory / "manifest.json", manifest)

    def read_manifest(self) -> dict:
        return json.loads((self.directory / "manifest.json").read_text(encoding="utf-8"))

    def write_table(self, record: dict) -> Path:
        """Two tables whose names differ only by replaced characters get different files."""
        name, own = file_name(record["schema"], record["table"]), (record["schema"], record["table"])
        n = 2
        while self.written.get(name, own) != own:
            name, n = file_name(record["schema"], f"{record['table']}~{n}"), n + 1
        self.written[name] = own
        self._write(path := self.directory / "tables" / name, record)
        return path

    def read_table(self, schema: str, table: str) -> dict:
        """By the manifest, which knows the file; without an entry there, by the name."""
        manifest = self.read_manifest() if (self.directory / "manifest.json").exists() else {}
        names = [t["recordFile"] for t in manifest.get("tables", []) if (t["schema"], t["table"]) == (schema, table) and "recordFile" in t]
        path = self.directory / (names[-1] if names else f"tables/{file_name(schema, table)}")
        return json.loads(path.read_text(encoding="utf-8"))

    def read_tables(self) -> list[dict]:
        """All records, each with the name of its file as ``recordFile``."""
        files = sorted((self.directory / "tables").glob("*.json"), key=lambda p: p.name.lower())
        return [json.loads(p.read_text(encoding="utf-8")) | {"recordFile": p.name} for p in files]
