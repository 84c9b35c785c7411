"""A profile as text."""

from __future__ import annotations

import sys
from typing import TextIO


def print_profile(schema: str, table: str, rows: list, out: TextIO | None = None) -> None:
    put = lambda text="": print(text, file=out or sys.stdout)
    put(f"Table: {schema}.{table}")
    put(f"Rows : {rows[0]['row_count'] if rows else 0}\n")
    for c in rows:
        put(f"[{c['name']}] {c['database_type_name']}{' PK' if c['declared_primary_key'] else ''}")
        put(f"  null={c['null_count']} ({c['null_rate'] * 100:.4f}%), blank={c['blank_count']}, semanticNull={c['semantic_null_count']}, distinct={c['distinct_count']}, uniqueness={c['uniqueness']:.6f}")
        if c["min_value"] is not None or c["max_value"] is not None:
            put(f"  range={c['min_value']} .. {c['max_value']}")
        if c["min_length"] is not None:
            put(f"  length={c['min_length']} .. {c['max_length']}, avg={c['avg_length']:.2f}")
        if c["lob_content_skipped"]:
            put("  large object: length only, no distinct values")
        for name, text in (("candidate_primary_key", "candidate-key"), ("potential_enum", "potential-enum"), ("constant", "constant"), ("quasi_constant", "quasi-constant")):
            if c[name]:
                put(f"  {text}=true")
        if c["trim_changed_count"] or c["case_variant_group_count"]:
            put(f"  normalization: trimChanged={c['trim_changed_count']}, caseVariantGroups={c['case_variant_group_count']}")
        if c["values"]:
            put("  values:")
            for v in c["values"]:
                put(f"    {v['value']} -> {v['count']} ({v['ratio'] * 100:.4f}%)")
        if c["patterns"]:
            put("  patterns: " + ", ".join(f"{p['pattern']}={p['count']}" for p in c["patterns"]))
        put()
