"""XLSB: the same projection as XLSX, from binary records."""

from __future__ import annotations

import struct

from leafmill.functions.cells import ERRORS, MOST_COLUMNS, family, sheet, show
from leafmill.functions.limits import DEFAULT, Limits
from leafmill.functions.tree import Builder, Document, Refused
from leafmill.sources.archive import Package
from leafmill.sources.xls import rk

_ROW, _SHEET, _ITEM, _FORMAT, _XF, _BEGIN_XFS, _END_XFS, _PROPS = 0, 156, 19, 44, 47, 617, 618, 153


def records(data: bytes):
    at, n = 0, len(data)
    while at < n:
        kind = data[at]
        at += 1
        if kind & 0x80 and at < n:
            kind = kind & 0x7F | (data[at] & 0x7F) << 7
            at += 1
        size = shift = 0
        while at < n and shift < 28:
            b = data[at]
            at += 1
            size |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                break
        if at + size > n:
            return
        yield kind, data[at : at + size]
        at += size


def text(d: bytes, at: int) -> tuple[str, int]:
    n, = struct.unpack_from("<I", d, at)
    if n == 0xFFFFFFFF:
        return "", at + 4
    end = at + 4 + 2 * n
    if end > len(d):
        raise ValueError("string ends early")
    return d[at + 4 : end].decode("utf-16-le", "replace"), end


def read(content: bytes, name: str = "", limits: Limits = DEFAULT) -> Document:
    pkg, out = Package(content, limits, "xlsb"), Builder(limits)
    main = next((r["target"] for r in pkg.relationships("").values() if r["type"] == "officeDocument"), "xl/workbook.bin")
    book = pkg.read(main)
    if book is None:
        raise Refused("xlsb.missing-workbook")
    rels = pkg.relationships(main)

    def part(kind: str) -> bytes:
        target = next((r["target"] for r in rels.values() if r["type"] == kind), None)
        return (pkg.read(target) if target else None) or b""

    strings = [text(d, 1)[0] for k, d in records(part("sharedStrings")) if k == _ITEM and len(d) >= 5]
    custom: dict[int, str] = {}
    kinds: list[str] = []
    inside = False
    for k, d in records(part("styles")):
        if k == _FORMAT:
            custom[struct.unpack_from("<H", d)[0]] = text(d, 2)[0]
        elif k in (_BEGIN_XFS, _END_XFS):
            inside = k == _BEGIN_XFS
        elif k == _XF and inside:
            kinds.append(family(struct.unpack_from("<H", d, 2)[0], custom))
    epoch, seen, failed = False, 0, 0
    for k, d in records(book):
        if k == _PROPS and d:
            epoch = bool(d[0] & 1)
        if k != _SHEET:
            continue
        seen += 1
        rel = title = None
        for skip in (8, 12):  # two layouts; the one that uses up the record is right
            try:
                rel, at = text(d, skip)
                title, end = text(d, at)
            except (struct.error, ValueError):
                continue
            if end == len(d):
                break
        target = rels.get(rel or "")
        data = pkg.read(target["target"]) if target else None
        if data is None or title is None:
            failed += 1
            continue
        rows: list[list[dict | None]] = []
        number = 0
        for kind, c in records(data):
            if kind == _ROW:
                number = struct.unpack_from("<I", c)[0] if len(c) >= 4 else len(rows)
                rows.append([])
            elif 1 <= kind <= 11 and rows and len(c) >= 8:
                col, style = struct.unpack_from("<II", c)
                if col >= MOST_COLUMNS:
                    continue
                shown = kinds[style & 0xFFFFFF] if style & 0xFFFFFF < len(kinds) else "number"
                try:
                    value, what = _value(kind, c, strings, shown, epoch)
                except (struct.error, ValueError):
                    value, what = "", "empty"
                line = rows[-1]
                if len(line) <= col:
                    line += [None] * (col - len(line))
                    line.append({"text": value, "value_type": what, "formula": None, "row": number})
        sheet(out, title, rows)
    if seen and failed == seen:
        raise Refused("xlsb.sheets-unreadable")
    if failed:
        out.report("xlsb.sheet-skipped", "warning", loss="dropped", count=failed)
    return out.doc


def _value(kind: int, c: bytes, strings: list[str], shown: str, epoch: bool) -> tuple[str, str]:
    if kind == 1:
        return "", "empty"
    if kind == 2:
        return show(rk(struct.unpack_from("<I", c, 8)[0]), shown, None, epoch), shown
    if kind in (3, 11):
        return ERRORS.get(c[8], "#ERR!"), "error"
    if kind in (4, 10):
        return "TRUE" if c[8] else "FALSE", "boolean"
    if kind in (5, 9):
        return show(struct.unpack_from("<d", c, 8)[0], shown, None, epoch), shown
    if kind in (6, 8):
        return text(c, 8)[0], "string"
    i, = struct.unpack_from("<I", c, 8)
    return (strings[i] if i < len(strings) else ""), "string"
