"""A workbook of three sheets, written as OOXML parts with the standard library."""

from __future__ import annotations

import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from . import report_texts as rt

# Headers and widths of the detail sheet.
DETAIL = (
    ("数据库", 16, lambda r, c: r["database"]), ("Schema", 16, lambda r, c: r["schema"]), ("表名", 22, lambda r, c: r["table"]), ("字段名", 22, lambda r, c: c["name"]),
    ("DB类型", 20, lambda r, c: rt.db_type(c)), ("主键", 10, lambda r, c: "是" if c["declaredPrimaryKey"] else ""), ("总行数", 14, lambda r, c: c["rowCount"]), ("NULL数", 12, lambda r, c: c["nullCount"]),
    ("NULL率", 12, lambda r, c: float(c["nullRate"])), ("空串/语义空", 16, lambda r, c: f"{c['blankCount']} / {c['semanticNullCount']}"), ("Distinct数", 14, lambda r, c: c["distinctCount"]),
    ("唯一率", 12, lambda r, c: float(c["uniqueness"])), ("最小值", 18, lambda r, c: c.get("minValue", "")), ("最大值", 18, lambda r, c: c.get("maxValue", "")), ("长度(最小/最大/平均)", 24, lambda r, c: rt.length_text(c)),
    ("枚举/TopN", 42, lambda r, c: rt.values_text(c["values"])), ("探查提示", 28, lambda r, c: rt.insights_text(c)),
)
INSIGHT = (("数据库", 16), ("Schema", 16), ("表名", 22), ("字段名", 22), ("提示类型", 18), ("说明", 64))
SHEETS = ("扫描概览", "字段质量明细", "探查提示")
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: A cell holds so many characters.
_CELL_MOST = 32_767


def _name(column: int) -> str:
    out = ""
    while column >= 0:
        out, column = chr(65 + column % 26) + out, column // 26 - 1
    return out


def _cell(row: int, column: int, value, style: int = 0) -> str:
    at = f'r="{_name(column)}{row}"'
    if isinstance(value, float):
        return f'<c {at} s="2"><v>{value!r}</v></c>'
    if isinstance(value, int):
        return f'<c {at} s="{style}"><v>{value}</v></c>'
    text = "".join(ch if ch in "\t\n\r" or ch >= " " else " " for ch in str(value or ""))[:_CELL_MOST]
    return f'<c {at} s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _sheet(rows: list[list], widths: list[int], header: bool, merge: str = "") -> str:
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if header else ""
    body = "".join(f'<row r="{i}">' + "".join(_cell(i, k, v, 1 if (header and i == 1) or (not header and k == 0) else 3 if header and len(str(v)) > 40 else 0) for k, v in enumerate(row)) + "</row>" for i, row in enumerate(rows, 1) if row)
    auto = f'<autoFilter ref="A1:{_name(len(widths) - 1)}{len(rows)}"/>' if header and len(rows) > 1 else ""
    return f"{_HEAD}<worksheet {_MAIN}>{view}<cols>{cols}</cols><sheetData>{body}</sheetData>{auto}{merge}</worksheet>"


def write_xlsx(path: str, manifest: dict, records: list[dict]) -> None:
    summary = [["数据质量 Profile 报告"], [], *[list(x) for x in rt.overview_lines(manifest, records)]]
    detail = [[h for h, _, _ in DETAIL], *[[f(r, c) for _, _, f in DETAIL] for r in records for c in r["columns"]]]
    insight = [[h for h, _ in INSIGHT], *rt.insight_list(records)]
    sheets = [
        _sheet(summary, [20, 32], False, '<mergeCells count="1"><mergeCell ref="A1:D1"/></mergeCells>'),
        _sheet(detail, [w for _, w, _ in DETAIL], True), _sheet(insight, [w for _, w in INSIGHT], True),
    ]
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in (1, 2, 3))
    parts = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{types}</Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{_HEAD}<workbook {_MAIN} xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(SHEETS, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2, 3)) + f'<Relationship Id="rId4" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{_HEAD}<styleSheet {_MAIN}><fonts count="2"><font/><font><b/></font></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf/><xf fontId="1" applyFont="1"/><xf numFmtId="10" applyNumberFormat="1"/><xf applyAlignment="1"><alignment wrapText="1" vertical="top"/></xf></cellXfs></styleSheet>',
    } | {f"xl/worksheets/sheet{i}.xml": s for i, s in enumerate(sheets, 1)}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
