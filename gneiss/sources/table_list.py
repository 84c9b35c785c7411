"""Lists of tables to profile: files of names, or names parted by commas."""

from __future__ import annotations

from .tables import TableRef


def default_schema(text: str | None) -> str:
    text = (text or "").strip()
    return "" if text == "-" else text


def parse_entry(entry: str, schema: str, line: int | None = None) -> TableRef:
    """``TABLE`` in the default schema, or ``SCHEMA.TABLE``."""
    where = f" (line {line})" if line else ""
    parts = [p.strip() for p in entry.split(".")]
    if len(parts) > 2 or not all(parts):
        raise ValueError(f"not a table name: {entry!r}{where}")
    if len(parts) == 1 and not schema:
        raise ValueError(f"no schema for table {entry!r}, and no default schema{where}")
    return TableRef(*(parts if len(parts) == 2 else (schema, parts[0])))



def parse_lines(lines, schema: str | None = None) -> list[TableRef]:
    """Blank lines and those that start with # are skipped; of names equal but for case the first stays; an empty list is an error."""
    schema, refs, seen = default_schema(schema), [], set()
    for n, line in enumerate(lines, 1):
        text = (line.removeprefix("\ufeff") if n == 1 else line).strip()
        if text and not text.startswith("#"):
            ref = parse_entry(text, schema, n)
            if (key := (ref.schema.upper(), ref.table.upper())) not in seen:
                seen.add(key)
                refs.append(ref)
    if not refs:
        raise ValueError("the list names no table")
    return refs


def read_file(path: str, schema: str | None = None) -> list[TableRef]:
    with open(path, encoding="utf-8") as f:
        return parse_lines(f.read().splitlines(), schema)


def parse_commas(text: str, schema: str | None = None) -> list[TableRef]:
    """The same rules for names parted by commas; empty ones are dropped. The schema may be none."""
    schema = default_schema(schema)
    return [parse_entry(t, schema) if "." in t or schema else TableRef("", t) for t in map(str.strip, text.split(",")) if t]
