"""Static pages: an index with a searchable list of tables, and a page for each table."""

from __future__ import annotations

from html import escape
from pathlib import Path

from . import report_texts as rt
from .store import file_name

INDEX, PAGES = "quality-profile.html", "quality-profile-tables"
_STYLE = """
body { font: 14px sans-serif; margin: 0 auto; max-width: 1500px; padding: 1rem; color: #222 }
.cards { display: flex; flex-wrap: wrap; gap: .7rem } .card { border: 1px solid #ccc; border-radius: 6px; padding: .6rem 1rem } .card b { display: block; font-size: 1.5rem }
table { border-collapse: collapse; width: 100% } th, td { border-bottom: 1px solid #ddd; padding: .4rem; text-align: left; vertical-align: top }
.tag { background: #e8ecf8; border-radius: 9px; padding: 1px 8px; margin-right: 3px } .muted { color: #777 } .values { max-width: 22rem; overflow-wrap: anywhere }
"""
_FIND = "function find(q){q=q.toLowerCase();for(const r of document.querySelectorAll('#tables tr'))r.hidden=!r.dataset.name.includes(q)}"


def _e(x) -> str:
    return escape("" if x is None else str(x), quote=True).replace("&#x27;", "&#39;")


def _page(title: str, body: str, script: str = "") -> str:
    return f'<!doctype html>\n<html lang="zh-CN"><head><meta charset="UTF-8"><title>{_e(title)}</title><style>{_STYLE}</style></head><body>{body}{f"<script>{script}</script>" if script else ""}</body></html>\n'


def _cards(pairs: list[tuple[str, int]]) -> str:
    return '<div class="cards">' + "".join(f'<div class="card"><span class="muted">{_e(k)}</span><b>{v}</b></div>' for k, v in pairs) + "</div>"


def display_name(r: dict) -> str:
    return f"{r['schema']}.{r['table']}" if r["schema"] else r["table"]


def page_name(r: dict) -> str:
    """After the record's file, so that tables with like names have pages of their own."""
    own = r.get("recordFile") or file_name(r["schema"], r["table"])
    return own.removesuffix(".json") + ".html"


def index_page(manifest: dict, records: list[dict]) -> str:
    t = rt.totals(records)
    cards = _cards([("已保存表", len(records)), ("字段总数", t["fields"]), ("累计扫描行数", t["rows"]), ("潜在枚举", t["enums"]), ("候选唯一键", t["keys"]), ("常量字段", t["constants"])])
    about = [("开始", rt.time_text(manifest.get("startedAtEpochMillis"))), ("结束", rt.time_text(manifest.get("finishedAtEpochMillis"))), ("成功表", manifest.get("successTables", 0)), ("失败表", manifest.get("failedTables", 0)), ("fetchSize", manifest.get("options", {}).get("fetchSize", ""))]
    rows = ""
    for r in records:
        one = rt.totals([r])
        link = f'<a href="{PAGES}/{_e(page_name(r))}">{_e(r["table"])}</a>'
        cells = [_e(r["database"]), _e(r["schema"]), link, r["rowCount"], one["fields"], one["enums"], one["keys"], one["constants"], r["durationMillis"]]
        rows += f'<tr data-name="{_e(display_name(r).lower())}">' + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    heads = "".join(f"<th>{h}</th>" for h in ("数据库", "Schema", "表名", "行数", "字段数", "潜在枚举", "候选唯一键", "常量字段", "耗时(ms)"))
    body = f"<h1>数据质量 Profile 报告</h1><p class='muted'>运行ID：{_e(manifest.get('runId'))} ｜ 数据库：{_e(manifest.get('database'))} ｜ {_e(manifest.get('status'))}</p>{cards}"
    body += "<p>" + "<br>".join(f"{k}：{_e(v)}" for k, v in about) + '</p><input placeholder="搜索表名或Schema" oninput="find(this.value)">'
    return _page("数据质量 Profile 报告", f"{body}<table><thead><tr>{heads}</tr></thead><tbody id='tables'>{rows}</tbody></table>", _FIND)


def table_page(r: dict) -> str:
    t = rt.totals([r])
    rows = ""
    for c in r["columns"]:
        tags = "".join(f'<span class="tag">{_e(x)}</span>' for x in rt.insights_text(c, "LOB仅画像长度").split("；") if x)
        values = "".join(f'<div>{_e(v.get("value", "<NULL>"))} <span class="muted">({v["count"]}, {rt.percent(v["ratio"])})</span></div>' for v in c["values"])
        length = f"最小：{c['minLength']}<br>最大：{c['maxLength']}<br>平均：{c['avgLength']:.2f}" if c.get("avgLength") is not None else ""
        cells = [
            f"<b>{_e(c['name'])}</b>", _e(c["databaseTypeName"]), "是" if c["declaredPrimaryKey"] else "", f"数量：{c['nullCount']}<br>比例：{rt.percent(c['nullRate'])}", f"空串：{c['blankCount']}<br>语义空：{c['semanticNullCount']}",
            f"Distinct：{c['distinctCount']}<br>唯一率：{rt.percent(c['uniqueness'])}", f"Min：{_e(c.get('minValue'))}<br>Max：{_e(c.get('maxValue'))}", length, tags, f'<div class="values">{values}</div>',
        ]
        rows += "<tr>" + "".join(f"<td>{x}</td>" for x in cells) + "</tr>"
    heads = "".join(f"<th>{h}</th>" for h in ("字段", "类型", "主键", "NULL", "空串/语义空", "唯一性", "范围", "长度", "探查提示", "枚举/TopN"))
    cards = _cards([("行数", r["rowCount"]), ("字段数", t["fields"]), ("潜在枚举", t["enums"]), ("候选唯一键", t["keys"]), ("常量字段", t["constants"])])
    head = f'<p><a href="../{INDEX}">← 返回表概览</a></p><h1>{_e(display_name(r))}</h1><p class="muted">数据库：{_e(r["database"])} ｜ 扫描耗时：{r["durationMillis"]} ms</p>'
    return _page(f"{display_name(r)} - Profile", f"{head}{cards}<table><thead><tr>{heads}</tr></thead><tbody>{rows}</tbody></table>")


def write_html(directory: str, manifest: dict, records: list[dict]) -> None:
    """Pages of earlier runs in the same folder go first."""
    pages = Path(directory) / PAGES
    pages.mkdir(parents=True, exist_ok=True)
    for old in pages.glob("*.html"):
        old.unlink()
    (Path(directory) / INDEX).write_text(index_page(manifest, records), encoding="utf-8")
    for r in records:
        (pages / page_name(r)).write_text(table_page(r), encoding="utf-8")
