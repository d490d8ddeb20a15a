"""DOCX."""

from __future__ import annotations

import re

from leafmill.functions.limits import DEFAULT, Limits
from leafmill.functions.runs import Lists, Runs
from leafmill.functions.tree import Builder, Document, Refused
from leafmill.operators.resources import MIMES
from leafmill.sources.archive import Element, Package, number

EMU_TWIP = 635
_MONO = re.compile(r"courier|consolas|mono|menlo|source code|lucida console", re.I)
_NUMBER_STYLES = {"decimal": "decimal", "lowerLetter": "lower_alpha", "upperLetter": "upper_alpha", "lowerRoman": "lower_roman", "upperRoman": "upper_roman"}


def _on(e: Element | None) -> bool:
    return e is not None and e.get("val") not in ("0", "false", "off", "none")


class _Reader:
    def __init__(self, content: bytes, limits: Limits):
        self.pkg = Package(content, limits, "docx")
        self.out = Builder(limits)
        main = next((r["target"] for r in self._try(lambda: self.pkg.relationships(""), {}).values() if r["type"] == "officeDocument"), "word/document.xml")
        self.main = main if main in self.pkg else "word/document.xml"
        root = self.pkg.xml(self.main)
        if root is None:
            raise Refused("docx.missing-document-part")
        self.body = root.child("body")
        self.rels = self._try(lambda: self.pkg.relationships(self.main), {})
        self.levels = self._try(self.headings, {})
        self.lists_of = self._try(self.numbering, {})
        self.notes = {**self.note_bodies("footnotes", "footnote"), **self.note_bodies("endnotes", "endnote")}
        self.note_numbers: dict[tuple[str, str], int] = {}
        self.counted: dict[str, int] = {}
        self.styles_seen: set[str] = set()
        self.runs = Runs(self.out)
        self.lists = Lists(self.out)
        self.fields: list[dict] = []
        self.page_done = False

    @staticmethod
    def _try(make, default):
        try:
            return make()
        except Refused:
            return default

    def part(self, kind: str) -> str | None:
        return next((r["target"] for r in self.rels.values() if r["type"] == kind and not r["external"]), None)

    # ---------------------------------------------------------- side parts
    def headings(self) -> dict[str, int]:
        root = self.pkg.xml(self.part("styles") or "word/styles.xml")
        own: dict[str, int] = {}
        based: dict[str, str] = {}
        for s in root.children("style") if root else ():
            if s.get("type", "paragraph") != "paragraph":
                continue
            ident = s.get("styleId", "")
            name = s.child("name").get("val", "") if s.child("name") else ""
            m = re.fullmatch(r"heading ?([1-9])", name, re.I) or re.fullmatch(r"Heading([1-9])", ident)
            if m:
                own[ident] = int(m.group(1))
            if s.child("basedOn") is not None:
                based[ident] = s.child("basedOn").get("val", "")
        out = {}
        for ident in {*own, *based}:
            at = ident
            for _ in range(16):
                if at in own:
                    out[ident] = own[at]
                    break
                if at not in based:
                    break
                at = based[at]
        return out

    def numbering(self) -> dict[tuple[str, int], dict]:
        root = self.pkg.xml(self.part("numbering") or "word/numbering.xml")
        if root is None:
            return {}
        abstract: dict[str, dict[int, dict]] = {}
        for a in root.children("abstractNum"):
            abstract[a.get("abstractNumId", "")] = {number(v.get("ilvl")): {"fmt": v.child("numFmt").get("val") if v.child("numFmt") else "decimal", "start": number(v.child("start").get("val"), 1) if v.child("start") else 1, "text": v.child("lvlText").get("val") if v.child("lvlText") else ""} for v in a.children("lvl")}
        out = {}
        for n in root.children("num"):
            base = abstract.get(n.child("abstractNumId").get("val", "") if n.child("abstractNumId") else "", {})
            for level, x in base.items():
                out[n.get("numId", ""), level] = x
        return out

    def note_bodies(self, kind: str, tag: str) -> dict[tuple[str, str], Element]:
        name = self.part(kind)
        root = self._try(lambda: self.pkg.xml(name), None) if name else None
        return {(tag, n.get("id", "")): n for n in (root.children(tag) if root else ()) if n.get("type") not in ("separator", "continuationSeparator", "continuationNotice")}

    def count(self, what: str, n: int = 1) -> None:
        self.counted[what] = self.counted.get(what, 0) + n

    # -------------------------------------------------------------- blocks
    def read(self) -> Document:
        if self.body is not None:
            self.blocks(self.body)
        self.lists.end()
        rest = sorted(self.styles_seen)
        if rest:
            self.out.doc.plugins["org.leafmill.docx"] = (1, {"paragraph_style_ids": rest})
        losses = {"page-breaks-dropped": "presentation", "section-properties-dropped": "presentation", "comments-dropped": "dropped", "tracked-deletions-dropped": "dropped", "text-boxes-dropped": "dropped", "embedded-objects-dropped": "dropped", "bookmarks-dropped": "none", "heading-level-clamped": "structural", "merged-cells-degraded": "structural"}
        for what, n in self.counted.items():
            self.out.report(f"docx.{what}", "note", loss=losses.get(what, "none"), count=n)
        return self.out.doc

    def blocks(self, parent: Element) -> None:
        for e in parent.children():
            t = e.tag
            if t == "p":
                self.paragraph(e)
            elif t == "tbl":
                self.lists.end()
                self.table(e)
            elif t == "sdt":
                self.control(e)
            elif t in ("ins", "moveTo", "customXml", "smartTag"):
                self.blocks(e)
            elif t in ("del", "moveFrom"):
                self.count("tracked-deletions-dropped")
            elif t == "sectPr":
                self.section(e)
            elif t in ("bookmarkStart",):
                self.count("bookmarks-dropped")
            elif t in ("bookmarkEnd", "proofErr", "commentRangeStart", "commentRangeEnd", "permStart", "permEnd"):
                pass
            elif t == "AlternateContent":
                inner = e.child("Choice") or e.child("Fallback")
                if inner:
                    self.blocks(inner)
            else:
                if t.endswith("Pr"):
                    continue
                self.out.report("docx.unhandled-construct", "note", loss="structural", context=t)
                self.blocks(e)

    def control(self, e: Element) -> None:
        content = e.child("sdtContent")
        tag = e.child("sdtPr", "tag")
        if content is None:
            return
        self.lists.end()
        self.out.open("container", attrs={"classes": [tag.get("val", "")]} if tag is not None and tag.get("val") else None)
        self.blocks(content)
        self.lists.end()
        self.out.close()

    def section(self, e: Element) -> None:
        self.count("section-properties-dropped")
        size = e.child("pgSz")
        if size is not None and not self.page_done and self.out.doc.body:
            self.page_done = True
            self.out.facet(self.out.doc.body[0], "layout", surface="page", surface_index=0, x=0, y=0, width=number(size.get("w")) * EMU_TWIP, height=number(size.get("h")) * EMU_TWIP)

    def paragraph(self, p: Element) -> None:
        pr = p.child("pPr")
        style = pr.child("pStyle").get("val", "") if pr and pr.child("pStyle") else ""
        num = pr.child("numPr") if pr else None
        level = self.levels.get(style)
        if style and level is None:
            self.styles_seen.add(style)
        ident = num.child("numId").get("val") if num and num.child("numId") else None
        has_content = any(e.tag in ("t", "drawing", "pict", "footnoteReference", "endnoteReference", "tab", "br", "object", "instrText") for e in p.walk())
        if ident not in (None, "0") and has_content:
            at = number(num.child("ilvl").get("val")) if num.child("ilvl") else 0
            kind = self.lists_of.get((ident, at), {"fmt": "bullet", "start": 1, "text": ""})
            ordered = kind["fmt"] not in ("bullet", "none")
            self.lists.item(at, ident, ordered, kind["start"], _NUMBER_STYLES.get(kind["fmt"], "decimal"), "paren" if (kind["text"] or "").endswith(")") else "period")
            self.out.open("plain")
        elif not has_content:
            if pr and pr.child("sectPr"):
                self.section(pr.child("sectPr"))
            return
        elif level is not None:
            self.lists.end()
            if level > 6:
                self.count("heading-level-clamped")
            self.out.open("heading", level=min(level, 6))
        else:
            self.lists.end()
            self.out.open("paragraph")
        node = self.out.current
        if style:
            self.out.facet(node, "style", name=style)
        self.inlines(p)
        self.runs.end()
        while self.fields:
            self.end_field()
        self.out.close()
        if not node.kids:
            self.drop(node)
        if pr and pr.child("sectPr"):
            self.section(pr.child("sectPr"))

    def drop(self, node) -> None:
        kids = self.out.blocks[-1][1]
        if node.tag != "plain" and kids and kids[-1] is node:
            kids.pop()

    def table(self, t: Element) -> None:
        out = self.out
        grid = t.child("tblGrid")
        rows = [r for x in t.children("tr", "sdt", "ins") for r in ([x] if x.tag == "tr" else [y for y in x.walk() if y.tag == "tr"])]
        if not rows:
            return
        columns = len(grid.children("gridCol")) if grid else max(len(r.children("tc")) for r in rows)
        out.open("table", alignments=["default"] * max(columns, 1))
        section = None
        for r in rows:
            head = section in (None, "table_head") and r.child("trPr") is not None and _on(r.child("trPr").child("tblHeader"))
            want = "table_head" if head else "table_body"
            if section != want:
                if section:
                    out.close()
                out.open(want)
                section = want
            out.open("table_row")
            for c in r.children("tc"):
                pr = c.child("tcPr")
                merge = pr.child("vMerge") if pr else None
                if merge is not None and merge.get("val") != "restart":
                    self.count("merged-cells-degraded")
                    continue
                span = number(pr.child("gridSpan").get("val"), 1) if pr and pr.child("gridSpan") else 1
                if merge is not None or span > 1:
                    self.count("merged-cells-degraded")
                out.open("table_cell", alignment="default", row_span=1, col_span=max(span, 1))
                held, self.lists = self.lists, Lists(out)
                self.blocks(c)
                self.lists.end()
                self.lists = held
                out.close()
            out.close()
        if section:
            out.close()
        out.close()

    # ------------------------------------------------------------- inlines
    def inlines(self, parent: Element) -> None:
        for e in parent.children():
            t = e.tag
            if t == "r":
                self.run(e)
            elif t == "hyperlink":
                self.hyperlink(e)
            elif t in ("ins", "moveTo"):
                if self.out.current is not None:
                    self.out.facet(self.out.current, "revision", revision="insertion", author=e.get("author", ""), timestamp=e.get("date", ""))
                self.inlines(e)
            elif t in ("del", "moveFrom"):
                self.count("tracked-deletions-dropped")
                if self.out.current is not None:
                    self.out.facet(self.out.current, "revision", revision="deletion", author=e.get("author", ""), timestamp=e.get("date", ""))
            elif t == "sdt":
                content, tag = e.child("sdtContent"), e.child("sdtPr", "tag")
                if content is not None:
                    self.runs.end()
                    self.out.begin("span", attrs={"classes": [tag.get("val", "")]} if tag is not None and tag.get("val") else None)
                    self.inlines(content)
                    self.runs.end()
                    self.out.end()
            elif t == "fldSimple":
                self.link_or_text(e.get("instr", ""), lambda e=e: self.inlines(e))
            elif t == "bookmarkStart":
                self.count("bookmarks-dropped")
            elif t == "commentReference":
                self.count("comments-dropped")
            elif t in ("smartTag", "customXml", "dir", "bdo"):
                self.inlines(e)
            elif t == "AlternateContent":
                inner = e.child("Choice") or e.child("Fallback")
                if inner:
                    self.inlines(inner)

    def link_or_text(self, instruction: str, content) -> None:
        url = hyperlink_target(instruction)
        if url is None:
            content()
            return
        self.runs.end()
        self.out.begin("link", url=url, title="")
        content()
        self.runs.end()
        self.out.end()

    def hyperlink(self, e: Element) -> None:
        rel = self.rels.get(e.get("id") or "")
        url = rel["target"] if rel and e.get("id") else ""
        if e.get("anchor"):
            url = (url if rel else "") + "#" + e.get("anchor")
        self.runs.end()
        self.out.begin("link", url=url, title=e.get("tooltip") or "")
        self.inlines(e)
        self.runs.end()
        self.out.end()

    def styles(self, r: Element) -> tuple[set[str], bool]:
        pr = r.child("rPr")
        out: set[str] = set()
        if pr is None:
            return out, False
        for tag, style in (("b", "strong"), ("i", "emphasis"), ("strike", "strikethrough"), ("dstrike", "strikethrough"), ("smallCaps", "small_caps"), ("u", "underline")):
            if _on(pr.child(tag)):
                out.add(style)
        v = pr.child("vertAlign")
        if v is not None and v.get("val") in ("superscript", "subscript"):
            out.add(v.get("val"))
        fonts = pr.child("rFonts")
        return out, fonts is not None and bool(_MONO.search(fonts.get("ascii") or fonts.get("hAnsi") or ""))

    def run(self, r: Element) -> None:
        styles, code = self.styles(r)
        for e in r.children():
            t = e.tag
            hidden = any(f["state"] == "code" for f in self.fields)
            if t == "fldChar":
                kind = e.get("fldCharType")
                if kind == "begin":
                    self.fields.append({"state": "code", "instr": "", "link": False})
                elif kind == "separate" and self.fields:
                    f = self.fields[-1]
                    f["state"] = "shown"
                    url = hyperlink_target(f["instr"])
                    if url is not None:
                        self.runs.end()
                        self.out.begin("link", url=url, title="")
                        f["link"] = True
                elif kind == "end" and self.fields:
                    self.end_field()
            elif t == "instrText" and self.fields:
                self.fields[-1]["instr"] += e.text()
            elif hidden:
                continue
            elif t == "t":
                (self.runs.code if code else self.runs.text)(e.text(), styles)
            elif t == "tab":
                self.runs.style(styles)
                self.out.space()
            elif t in ("br", "cr"):
                if e.get("type") in ("page", "column"):
                    self.count("page-breaks-dropped")
                else:
                    self.runs.style(styles)
                    self.out.hard_break()
            elif t == "noBreakHyphen":
                self.runs.text("‑", styles)
            elif t in ("footnoteReference", "endnoteReference"):
                self.note(t.removesuffix("Reference"), e.get("id", ""))
            elif t in ("drawing", "pict"):
                self.drawing(e)
            elif t == "object":
                self.count("embedded-objects-dropped")
            elif t == "commentReference":
                self.count("comments-dropped")
            elif t == "AlternateContent":
                for d in e.walk():
                    if d.tag in ("drawing", "pict"):
                        self.drawing(d)
                        break

    def end_field(self) -> None:
        f = self.fields.pop()
        if f["link"]:
            self.runs.end()
            self.out.end()

    def note(self, kind: str, ident: str) -> None:
        body = self.notes.get((kind, ident))
        if body is None:
            return
        self.runs.end()
        if (kind, ident) not in self.note_numbers:
            held = self.runs, self.lists, self.fields
            self.note_numbers[kind, ident] = self.out.note()
            self.runs, self.lists, self.fields = Runs(self.out), Lists(self.out), []
            self.blocks(body)
            self.lists.end()
            self.out.end_note()
            self.runs, self.lists, self.fields = held
        self.out.inline("note", note=self.note_numbers[kind, ident])

    def drawing(self, e: Element) -> None:
        if any(x.tag == "txbxContent" for x in e.walk()):
            self.count("text-boxes-dropped")
            return
        embed = next((x.get("embed") or x.get("id") for x in e.walk() if x.tag in ("blip", "imagedata") and (x.get("embed") or x.get("id"))), None)
        alt = next((x.get("descr") for x in e.walk() if x.get("descr")), "")
        rel = self.rels.get(embed or "")
        if rel is None:
            return
        self.runs.end()
        target = rel["target"]
        content = None if rel["external"] else self.pkg.read(target)
        mime = MIMES.get(target.rsplit(".", 1)[-1].lower(), "application/octet-stream")
        self.out.begin("image", url=target, title="", resource=self.out.resource(target, content, mime, alt))
        self.out.text(alt)
        self.out.end()


def hyperlink_target(instruction: str) -> str | None:
    m = re.match(r'\s*HYPERLINK\s+(?:\\l\s+)?(?:"([^"]*)"|(\S+))', instruction)
    if not m:
        return None
    local = bool(re.match(r"\s*HYPERLINK\s+\\l", instruction))
    return ("#" if local else "") + (m.group(1) if m.group(1) is not None else m.group(2))


def read(content: bytes, name: str = "", limits: Limits = DEFAULT) -> Document:
    return _Reader(content, limits).read()
