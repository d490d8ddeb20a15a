"""What spreadsheets share: number formats, serial dates, column letters, and a sheet as heading and table."""

from __future__ import annotations

import re
from datetime import date, timedelta
from decimal import Decimal

from leafmill.functions.tree import Builder

MOST_COLUMNS = 1024
# Built-in number formats that show dates and percentages, and error names.
DATE_FORMATS = {*range(14, 23), 45, 46, 47}
PERCENT_FORMATS = {9, 10}
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A", 0x2B: "#GETTING_DATA"}


def family(number_format: int, custom: dict[int, str]) -> str:
    if number_format in DATE_FORMATS:
        return "date"
    if number_format in PERCENT_FORMATS:
        return "percent"
    code = custom.get(number_format)
    if code is None:
        return "number"
    code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code)
    return "percent" if "%" in code else "date" if re.search("[ydhmsYDHMS]", code) else "number"


def shortest(x: float) -> str:
    """The shortest digits that read back the same, never with an exponent."""
    if x != x or x in (float("inf"), float("-inf")):
        return str(x)
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else format(Decimal(repr(x)), "f")


def show(x: float, kind: str, raw: str | None = None, epoch_1904: bool = False) -> str:
    if kind == "date":
        day = int(x // 1) + (1462 if epoch_1904 else 0)
        if 1 <= day <= 2_958_465:
            return (date(1899, 12, 30) + timedelta(days=day)).isoformat()
    if kind == "percent":
        return shortest(x * 100) + "%"
    return raw if raw is not None else shortest(x)


def column_of(reference: str) -> int | None:
    """'BC12' -> 54."""
    n = 0
    for c in reference.upper():
        if not "A" <= c <= "Z":
            break
        n = n * 26 + ord(c) - 64
    return n - 1 if n else None


def sheet(out: Builder, name: str, rows: list[list[dict | None]]) -> None:
    """rows of cells {text, value_type, formula, row, column}; gaps and short rows are filled with empty cells."""
    width = min(MOST_COLUMNS, max((len(r) for r in rows), default=0))
    if not width:
        return
    out.open("heading", level=2)
    out.text(name)
    out.close()
    out.open("table", alignments=["default"] * width)
    for k, row in enumerate(rows):
        if k < 2:
            if k:
                out.close()
            out.open("table_body" if k else "table_head")
        out.open("table_row")
        for j in range(width):
            c = row[j] if j < len(row) else None
            cell = out.open("table_cell", alignment="default", row_span=1, col_span=1)
            out.open("plain")
            if c and c["text"]:
                out.text(c["text"])
            out.close()
            out.close()
            if c and (c["text"] or c.get("formula")):
                out.facet(cell, "grid", sheet=name, row=c["row"], col=j, value_type=c["value_type"], formula=c.get("formula") or "", cached=c["text"], merge_rows=c.get("merge_rows", 1), merge_cols=c.get("merge_cols", 1))
        out.close()
    out.close()
    out.close()
