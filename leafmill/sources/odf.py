"""ODT, ODS and ODP."""

from __future__ import annotations

import re

from leafmill.functions.cells import MOST_COLUMNS, sheet, shortest
from leafmill.functions.limits import DEFAULT, Limits
from leafmill.functions.runs import Runs
from leafmill.functions.tree import Builder, Document, Refused
from leafmill.operators.resources import MIMES
from leafmill.sources.archive import Element, Package, number

MOST_ROWS = 65_536
# EMU in the units of lengths.
_EMU = {"cm": 360_000, "mm": 36_000, "in": 914_400, "pt": 12_700, "pc": 152_400, "px": 9_525}


def emu(length: str | None) -> int:
    m = re.match(r"(-?[0-9.]+)(cm|mm|in|pt|pc|px)", length or "")
    return round(float(m.group(1)) * _EMU[m.group(2)]) if m else 0


class _Odf:
    def __init__(self, content: bytes, limits: Limits, code: str):
        self.code, self.pkg, self.out = code, Package(content, limits, code), Builder(limits)
        manifest = self.pkg.read("META-INF/manifest.xml")
        if manifest and b"encryption-data" in manifest:
            raise Refused(f"{code}.encrypted")
        root = self.pkg.xml("content.xml")
        if root is None:
            raise Refused(f"{code}.missing-content")
        self.root, self.body = root, root.child("body")
        self.own: dict[str, dict] = {}
        for source in (self._part("styles.xml"), root):
            for section in source.children("styles", "automatic-styles") if source else ():
                for s in section.children("style", "list-style"):
                    self.own[s.tag, s.get("name", "")] = self._style(s)
        meta = self._part("meta.xml")
        for key, tag in (("title", "title"), ("author", "creator"), ("language", "language"), ("date", "date")):
            e = next((x for x in meta.walk() if x.tag == tag), None) if meta else None
            if e is not None and e.text().strip():
                self.out.meta(key, e.text().strip())
        self.runs = Runs(self.out)

    def _part(self, name: str) -> Element | None:
        try:
            return self.pkg.xml(name)
        except Refused:
            return None

    @staticmethod
    def _style(s: Element) -> dict:
        out: dict = {"parent": s.get("parent-style-name"), "styles": set(), "mono": False, "ordered": {}, "list": s.get("list-style-name"), "name": s.get("display-name") or s.get("name", "")}
        for p in s.children("text-properties"):
            if p.get("font-weight") in ("bold", "700", "800", "900", "600"):
                out["styles"].add("strong")
            if p.get("font-style") in ("italic", "oblique"):
                out["styles"].add("emphasis")
            if p.get("text-line-through-style") not in (None, "none") or p.get("text-line-through-type") not in (None, "none"):
                out["styles"].add("strikethrough")
            if p.get("text-underline-style") not in (None, "none"):
                out["styles"].add("underline")
            if p.get("font-variant") == "small-caps":
                out["styles"].add("small_caps")
            at = (p.get("text-position") or "").split(" ")[0]
            if at.startswith("super") or re.match(r"[1-9]", at):
                out["styles"].add("superscript")
            elif at.startswith(("sub", "-")):
                out["styles"].add("subscript")
            if re.search(r"courier|mono|consolas", p.get("font-name") or p.get("font-family") or "", re.I):
                out["mono"] = True
        for level in s.children("list-level-style-number", "list-level-style-bullet"):
            out["ordered"][number(level.get("level"), 1)] = level.tag.endswith("number") and bool(level.get("num-format", "1"))
        return out

    def style(self, name: str | None) -> tuple[set[str], bool]:
        """Properties of a style and of up to 16 of its parents, together: a child can't switch one off."""
        styles: set[str] = set()
        mono = False
        for _ in range(16):
            s = self.own.get(("style", name or ""))
            if s is None:
                break
            styles |= s["styles"]
            mono |= s["mono"]
            name = s["parent"]
        return styles, mono

    # ------------------------------------------------------------- inlines
    def inlines(self, parent: Element, styles: set[str], mono: bool) -> None:
        for e in parent.kids:
            if isinstance(e, str):
                (self.runs.code if mono else self.runs.text)(e, styles)
                continue
            t = e.tag
            if t == "span":
                s, m = self.style(e.get("style-name"))
                self.inlines(e, styles | s, mono or m)
            elif t == "a":
                self.runs.end()
                self.out.begin("link", url=e.get("href", ""), title=e.get("title") or "")
                self.inlines(e, styles, mono)
                self.runs.end()
                self.out.end()
            elif t in ("s", "tab"):
                self.runs.style(styles)
                self.out.space()
            elif t == "line-break":
                self.runs.style(styles)
                self.out.hard_break()
            elif t == "note":
                self.note(e)
            elif t == "annotation":
                self.out.report(f"{self.code}.annotations-dropped", "note", loss="dropped")
                if self.out.current is not None:
                    who = next((x.text() for x in e.walk() if x.tag == "creator"), "")
                    when = next((x.text() for x in e.walk() if x.tag == "date"), "")
                    said = " ".join(p.text() for p in e.walk() if p.tag == "p")
                    self.out.facet(self.out.current, "revision", revision="comment", author=who, timestamp=when, note=said)
            elif t in ("frame", "image"):
                self.image(e)
            elif t in ("bookmark", "bookmark-start", "bookmark-end", "annotation-end", "soft-page-break", "reference-mark"):
                pass
            else:
                self.inlines(e, styles, mono)

    def note(self, e: Element) -> None:
        body = e.child("note-body")
        self.runs.end()
        held = self.runs
        n = self.out.note()
        self.runs = Runs(self.out)
        if body is not None:
            self.blocks(body)
        self.out.end_note()
        self.runs = held
        self.out.inline("note", note=n)

    def image(self, frame: Element) -> None:
        image = next((x for x in frame.walk() if x.tag == "image"), None)
        if image is None or not image.get("href"):
            self.out.report(f"{self.code}.frame-dropped", "note", loss="dropped")
            return
        href = image.get("href").removeprefix("./")
        alt = next((x.text() for x in frame.walk() if x.tag == "desc"), None) or next((x.text() for x in frame.walk() if x.tag == "title"), None) or frame.get("name") or ""
        mime = MIMES.get(href.rsplit(".", 1)[-1].lower(), "application/octet-stream")
        self.runs.end()
        self.out.begin("image", url=href, title="", resource=self.out.resource(href, self.pkg.read(href), mime, alt))
        self.out.text(alt)
        self.out.end()

    # -------------------------------------------------------------- blocks
    def blocks(self, parent: Element) -> None:
        for e in parent.children():
            t = e.tag
            if t == "p":
                self.paragraph(e, "paragraph")
            elif t == "h":
                level = number(e.get("outline-level"), 1)
                self.paragraph(e, "heading", level=min(max(level, 1), 6))
            elif t == "list":
                self.list(e, 1, None)
            elif t == "table":
                self.table(e)
            elif t == "section":
                self.out.open("container", attrs={"classes": ["section"]})
                self.blocks(e)
                self.out.close()
            elif t in ("frame",):
                self.out.open("paragraph")
                self.image(e)
                self.runs.end()
                node = self.out.close()
                if not node.kids:
                    self.out.blocks[-1][1].pop()
            elif t in ("tracked-changes", "sequence-decls", "forms", "variable-decls", "user-field-decls"):
                if t == "tracked-changes":
                    self.out.report(f"{self.code}.tracked-changes-dropped", "note", loss="dropped")
            elif t in ("table-of-content", "illustration-index", "alphabetical-index", "index-body"):
                self.blocks(e)
            else:
                self.blocks(e)

    def paragraph(self, e: Element, tag: str, **p: object) -> None:
        node = self.out.open(tag, **p)
        if e.get("style-name"):
            self.out.facet(node, "style", name=e.get("style-name"))
        self.inlines(e, *(self.style(e.get("style-name")) if tag != "heading" else (set(), False)))
        self.runs.end()
        self.out.close()
        if not node.kids and tag != "plain":
            self.out.blocks[-1][1].pop()

    def list(self, e: Element, level: int, style: str | None) -> None:
        style = e.get("style-name") or style
        s = self.own.get(("list-style", style or ""), {"ordered": {}})
        items = e.children("list-item", "list-header")
        if not items:
            return
        first = number(items[0].get("start-value"), 1)
        self.out.open("list", kind="ordered" if s["ordered"].get(level) else "unordered", start=first, style="decimal", delimiter="period")
        for item in items:
            self.out.open("list_item")
            for k in item.children():
                if k.tag in ("p", "h"):
                    self.paragraph(k, "plain")
                elif k.tag == "list":
                    self.list(k, level + 1, style)
                else:
                    self.blocks(_only(k))
            self.out.close()
        self.out.close()

    def table(self, e: Element) -> None:
        out = self.out
        columns = sum(min(number(c.get("number-columns-repeated"), 1), MOST_COLUMNS) for c in e.walk() if c.tag == "table-column")
        head = [r for h in e.children("table-header-rows") for r in h.children("table-row")]
        body = [r for x in e.children() if x.tag in ("table-row", "table-rows", "table-row-group") for r in ([x] if x.tag == "table-row" else x.children("table-row"))]
        if not head and not body:
            return
        out.open("table", alignments=["default"] * max(1, min(columns, MOST_COLUMNS)))
        for section, rows in (("table_head", head), ("table_body", body)):
            if not rows:
                continue
            out.open(section)
            for r in rows:
                out.open("table_row")
                for c in r.children("table-cell"):
                    for _ in range(min(number(c.get("number-columns-repeated"), 1), MOST_COLUMNS)):
                        out.open("table_cell", alignment="default", row_span=max(1, number(c.get("number-rows-spanned"), 1)), col_span=max(1, number(c.get("number-columns-spanned"), 1)))
                        self.blocks(c)
                        out.close()
                out.close()
            out.close()
        out.close()


def _only(e: Element) -> Element:
    holder = Element("", "", {})
    holder.kids = [e]
    return holder


def read_odt(content: bytes, name: str = "", limits: Limits = DEFAULT) -> Document:
    r = _Odf(content, limits, "odt")
    text = r.body.child("text") if r.body else None
    if text is not None:
        r.blocks(text)
    return r.out.doc


def read_ods(content: bytes, name: str = "", limits: Limits = DEFAULT) -> Document:
    r = _Odf(content, limits, "ods")
    book = r.body.child("spreadsheet") if r.body else None
    for t in book.children("table") if book else ():
        rows: list[list[dict | None]] = []
        todo = [x for x in t.children()]
        lines: list[Element] = []
        while todo:
            x = todo.pop(0)
            if x.tag == "table-row":
                lines.append(x)
            elif x.tag in ("table-rows", "table-header-rows", "table-row-group"):
                todo = x.children() + todo
        for line in lines:
            row: list[dict | None] = []
            for c in line.children("table-cell"):  # covered cells belong to the one that covers them
                text, kind = _ods_cell(c)
                formula = c.get("formula")
                notes = len(c.children("annotation"))
                if notes:
                    r.out.report("ods.annotations-dropped", "note", loss="dropped", count=notes)
                if formula and not text and not any(x.code == "ods.formula-without-cached-value" for x in r.out.doc.reports):
                    r.out.report("ods.formula-without-cached-value", "note", loss="dropped")
                merged = {"merge_rows": number(c.get("number-rows-spanned"), 1), "merge_cols": number(c.get("number-columns-spanned"), 1)}
                cell = {"text": text, "value_type": kind, "formula": formula, "row": 0, **merged} if text or formula else None
                n = min(number(c.get("number-columns-repeated"), 1), MOST_COLUMNS - len(row))
                row += [cell] * max(n, 0)
            while row and row[-1] is None:
                row.pop()
            for _ in range(min(max(number(line.get("number-rows-repeated"), 1), 1), MOST_ROWS) if row else 1):
                rows.append([None if c is None else {**c, "row": len(rows)} for c in row])
        while rows and not rows[-1]:
            rows.pop()
        sheet(r.out, t.get("name", ""), rows)
    return r.out.doc


def _ods_cell(c: Element) -> tuple[str, str]:
    kind, value = c.get("value-type"), c.get("value")
    if kind in ("float", "currency") and value is not None:
        return value, "number"
    if kind == "percentage" and value is not None:
        return shortest(float(value) * 100) + "%", "percent"
    if kind == "date" and c.get("date-value"):
        return c.get("date-value").split("T")[0], "date"
    if kind == "time" and c.get("time-value"):
        m = re.fullmatch(r"PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:[.,]\d+)?S)?", c.get("time-value"))
        return (":".join(f"{int(x or 0):02d}" for x in m.groups()) if m else c.get("time-value")), "date"
    if kind == "boolean" and c.get("boolean-value"):
        return c.get("boolean-value").upper(), "boolean"
    text = " ".join(_shown(p) for p in c.children("p"))
    return text, "string" if text else "empty"


def _shown(p: Element) -> str:
    out = []
    for k in p.kids:
        if isinstance(k, str):
            out.append(k)
        elif k.tag in ("s", "tab"):
            out.append(" ")
        elif k.tag != "annotation":
            out.append(_shown(k))
    return "".join(out)


def read_odp(content: bytes, name: str = "", limits: Limits = DEFAULT) -> Document:
    r = _Odf(content, limits, "odp")
    deck = r.body.child("presentation") if r.body else None
    r.out.report("odp.presentation-projection", "note", loss="presentation")
    for k, page in enumerate(deck.children("page") if deck else ()):
        frames = [f for f in page.walk() if f.tag in ("frame", "custom-shape") and not _in_notes(page, f)]
        title = next((f for f in frames if f.get("class") == "title"), None)
        r.out.open("heading", level=2)
        text = " ".join(p.text() for p in title.walk() if p.tag in ("p", "h")) if title else ""
        r.out.text(text.strip() or page.get("name") or "Slide")
        r.out.close()
        for f in frames:
            if f is title:
                continue
            before = len(r.out.blocks[-1][1])
            box = f.child("text-box") or (f if f.tag == "custom-shape" else None)
            if box is not None:
                r.blocks(box)
            elif f.child("table") is not None:
                r.table(f.child("table"))
            elif f.child("image") is not None:
                r.blocks(_only(f))
            kids = r.out.blocks[-1][1]
            if len(kids) > before:
                r.out.facet(kids[before], "layout", surface="slide", surface_index=k, x=emu(f.get("x")), y=emu(f.get("y")), width=emu(f.get("width")), height=emu(f.get("height")))
        notes = page.child("notes")
        if notes is not None:
            boxes = [b for b in notes.walk() if b.tag == "text-box" and b.text().strip()]
            if boxes:
                r.out.open("container", attrs={"classes": ["notes"]})
                for b in boxes:
                    r.blocks(b)
                r.out.close()
    return r.out.doc


def _in_notes(page: Element, frame: Element) -> bool:
    notes = page.child("notes")
    return notes is not None and any(x is frame for x in notes.walk())
