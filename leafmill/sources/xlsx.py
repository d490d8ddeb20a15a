"""XLSX: each sheet with cells is a heading and a table, in workbook order."""

from __future__ import annotations

from leafmill.functions.cells import MOST_COLUMNS, column_of, family, sheet, show
from leafmill.functions.limits import DEFAULT, Limits
from leafmill.functions.tree import Builder, Document, Refused
from leafmill.sources.archive import Element, Package, number


def _shared(root: Element | None) -> list[str]:
    return ["".join(t.text() for t in _texts(si)) for si in (root.children("si") if root else ())]


def _texts(si: Element):
    for k in si.children():
        if k.tag == "t":
            yield k
        elif k.tag == "r":
            yield from k.children("t")


def read(content: bytes, name: str = "", limits: Limits = DEFAULT) -> Document:
    pkg, out = Package(content, limits, "xlsx"), Builder(limits)
    main = next((r["target"] for r in pkg.relationships("").values() if r["type"] == "officeDocument"), "xl/workbook.xml")
    book = pkg.xml(main) or pkg.xml("xl/workbook.xml")
    if book is None:
        raise Refused("xlsx.missing-workbook")
    rels = pkg.relationships(main)

    def part(kind: str) -> Element | None:
        target = next((r["target"] for r in rels.values() if r["type"] == kind), None)
        try:
            return pkg.xml(target) if target else None
        except Refused:
            return None

    strings = _shared(part("sharedStrings"))
    styles = part("styles")
    custom = {number(f.get("numFmtId")): f.get("formatCode", "") for f in (styles.child("numFmts").children() if styles and styles.child("numFmts") else ())}
    kinds = [family(number(x.get("numFmtId")), custom) for x in (styles.child("cellXfs").children("xf") if styles and styles.child("cellXfs") else ())]
    epoch = book.child("workbookPr") is not None and book.child("workbookPr").get("date1904") in ("1", "true")
    missing = 0
    for s in book.child("sheets").children("sheet") if book.child("sheets") else ():
        rel = rels.get(s.get("id", ""))
        try:
            root = pkg.xml(rel["target"]) if rel else None
        except Refused:
            out.report("xlsx.malformed-sheet", "warning", loss="dropped", context=s.get("name", ""))
            continue
        if root is None:
            continue
        rows = []
        for k, r in enumerate(root.child("sheetData").children("row") if root.child("sheetData") else ()):
            row: list[dict | None] = []
            for c in r.children("c"):
                at = column_of(c.get("r", "")) if c.get("r") else len(row)
                if at is None or at >= MOST_COLUMNS:
                    continue
                formula = c.child("f").text() if c.child("f") else None
                value = c.child("v").text() if c.child("v") else None
                text, kind = _cell(c, value, strings, kinds, epoch)
                if formula is not None and value is None and c.child("is") is None:
                    missing += 1
                row += [None] * (at - len(row))
                row[at:] = [{"text": text, "value_type": kind, "formula": formula, "row": k}]
            rows.append(row)
        sheet(out, s.get("name", ""), rows)
    if missing:
        out.report("xlsx.formula-without-cached-value", "note", loss="dropped", count=missing)
    return out.doc


def _cell(c: Element, value: str | None, strings: list[str], kinds: list[str], epoch: bool) -> tuple[str, str]:
    t = c.get("t", "n")
    if t == "inlineStr":
        return "".join(x.text() for x in _texts(c.child("is"))) if c.child("is") else "", "string"
    if value is None:
        return "", "empty"
    if t == "s":
        i = number(value, -1)
        return strings[i] if 0 <= i < len(strings) else "", "string"
    if t == "b":
        return "TRUE" if value.strip() == "1" else "FALSE", "boolean"
    if t in ("str", "e", "d"):
        return value, "error" if t == "e" else "string"
    style = number(c.get("s"))
    kind = kinds[style] if style < len(kinds) else "number"
    try:
        return show(float(value), kind, value, epoch), kind
    except ValueError:
        return value, "string"
