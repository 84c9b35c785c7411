"""What reports say about a record; records are small and local here, read back from their files."""

from __future__ import annotations

from datetime import datetime

from ..functions import texts
from ..functions.types import type_text


def percent(x: float) -> str:
    return f"{x * 100:.2f}%"


def time_text(millis: int | None) -> str:
    return datetime.fromtimestamp(millis / 1000).strftime("%Y-%m-%d %H:%M:%S") if millis and millis > 0 else ""


def values_text(values: list[dict]) -> str:
    out = ""
    for v in values:
        out += ("; " if out else "") + f"{v.get('value', '<NULL>')}({v['count']}, {percent(v['ratio'])})"
        if len(out) > texts.MOST_CHARS:
            return out + " ..."
    return out


def insights_text(c: dict, lob: str = texts.LOB_ONLY) -> str:
    found = [(c["potentialEnum"], texts.ENUM), (c["candidatePrimaryKey"], texts.KEY), (c["constant"], texts.CONSTANT), (c["quasiConstant"] and not c["constant"], texts.QUASI), (c["lobContentSkipped"], lob)]
    return "；".join(t for on, t in found if on)


def length_text(c: dict) -> str:
    return f"{c['minLength']} / {c['maxLength']} / {c['avgLength']:.2f}" if c.get("avgLength") is not None else ""


def db_type(c: dict) -> str:
    return type_text(c["databaseTypeName"], c["jdbcType"], c["precision"], c["scale"])


def totals(records: list[dict]) -> dict[str, int]:
    columns = [c for r in records for c in r["columns"]]
    count = lambda k: sum(bool(c[k]) for c in columns)
    return {"fields": len(columns), "rows": sum(r["rowCount"] for r in records), "enums": count("potentialEnum"), "keys": count("candidatePrimaryKey"), "constants": count("constant")}


def overview_lines(manifest: dict, records: list[dict]) -> list[tuple[str, str]]:
    t = totals(records)
    return [
        ("运行ID", manifest.get("runId", "")), ("数据库", manifest.get("database", "")), ("运行状态", manifest.get("status", "")), ("开始时间", time_text(manifest.get("startedAtEpochMillis"))),
        ("结束时间", time_text(manifest.get("finishedAtEpochMillis"))), ("计划表数", str(manifest.get("totalTables", 0))), ("成功表数", str(manifest.get("successTables", 0))), ("失败表数", str(manifest.get("failedTables", 0))),
        ("已保存表记录", str(len(records))), ("字段总数", str(t["fields"])), ("累计扫描行数", str(t["rows"])), ("潜在枚举字段", str(t["enums"])), ("候选唯一键字段", str(t["keys"])), ("常量字段", str(t["constants"])),
        ("fetchSize", str(manifest.get("options", {}).get("fetchSize", ""))),
    ]


def insight_list(records: list[dict]) -> list[list[str]]:
    out = []
    for r in records:
        for c in r["columns"]:
            head = [r["database"], r["schema"], r["table"], c["name"]]
            if c["potentialEnum"]:
                out.append([*head, texts.ENUM, values_text(c["values"])])
            if c["candidatePrimaryKey"]:
                out.append([*head, texts.KEY, "非空且唯一率=" + percent(c["uniqueness"])])
            if c["constant"]:
                out.append([*head, texts.CONSTANT, "Distinct=1" + (f", value={c['values'][0].get('value')}" if c["values"] else "")])
            elif c["quasiConstant"]:
                out.append([*head, "准常量字段", "值高度集中"])
    return out
