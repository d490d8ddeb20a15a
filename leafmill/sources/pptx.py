"""PPTX: a slide is a heading and its shapes in order; speaker notes are a container."""

from __future__ import annotations

from leafmill.functions.limits import DEFAULT, Limits
from leafmill.functions.runs import Lists, Runs
from leafmill.functions.tree import Builder, Document, Refused
from leafmill.operators.resources import MIMES
from leafmill.sources.archive import Element, Package, number


class _Slide:
    def __init__(self, pkg: Package, out: Builder, part: str):
        self.pkg, self.out, self.part = pkg, out, part
        self.rels = pkg.relationships(part)
        self.runs, self.lists = Runs(out), Lists(out)

    def shapes(self, tree: Element, index: int, notes: bool = False) -> None:
        for s in tree.children():
            if s.tag == "sp":
                kind = next((p.get("type", "") for p in s.walk() if p.tag == "ph"), None)
                if notes and kind != "body":
                    continue
                if kind in ("dt", "ftr", "sldNum", "sldImg"):
                    continue
                body = s.child("txBody")
                if body is not None:
                    before = len(self.out.blocks[-1][1])
                    self.text_body(body, kind)
                    self.place(s, before, index)
            elif s.tag == "grpSp":
                self.shapes(s, index, notes)
            elif s.tag == "graphicFrame":
                table = next((x for x in s.walk() if x.tag == "tbl"), None)
                before = len(self.out.blocks[-1][1])
                if table is not None:
                    self.table(table)
                    self.place(s, before, index)
                else:
                    self.out.report("pptx.graphic-dropped", "note", loss="dropped")
            elif s.tag == "pic" and not notes:
                before = len(self.out.blocks[-1][1])
                self.picture(s)
                self.place(s, before, index)

    def place(self, s: Element, before: int, index: int) -> None:
        kids = self.out.blocks[-1][1]
        at = next((x for x in s.walk() if x.tag == "xfrm"), None)
        if at is None or len(kids) <= before or at.child("off") is None or at.child("ext") is None:
            return
        off, ext = at.child("off"), at.child("ext")
        self.out.facet(kids[before], "layout", surface="slide", surface_index=index, x=number(off.get("x")), y=number(off.get("y")), width=number(ext.get("cx")), height=number(ext.get("cy")))

    def text_body(self, body: Element, kind: str | None) -> None:
        for p in body.children("p"):
            if not any(x.tag in ("r", "fld") and x.child("t") is not None and x.child("t").text() for x in p.children()) and not p.children("br"):
                continue
            pr = p.child("pPr")
            level = number(pr.get("lvl")) if pr else 0
            auto = pr.child("buAutoNum") if pr else None
            bullet = pr is not None and pr.child("buChar") is not None
            plain = pr is not None and pr.child("buNone") is not None
            if kind in ("title", "ctrTitle"):
                self.lists.end()
                self.out.open("heading", level=2)
            elif auto is not None or bullet or (level > 0 and not plain):
                style = "paren" if auto is not None and "Paren" in auto.get("type", "") else "period"
                self.lists.item(level, "auto" if auto is not None else "bullet", auto is not None, number(auto.get("startAt"), 1) if auto is not None else 1, delimiter=style)
                self.out.open("plain")
            else:
                self.lists.end()
                self.out.open("paragraph")
            self.inlines(p)
            self.runs.end()
            self.out.close()
        self.lists.end()

    def inlines(self, p: Element) -> None:
        for r in p.children():
            if r.tag == "br":
                self.out.hard_break()
            if r.tag not in ("r", "fld") or r.child("t") is None:
                continue
            pr = r.child("rPr")
            styles = set()
            link = None
            if pr is not None:
                for name, style in (("b", "strong"), ("i", "emphasis")):
                    if pr.get(name) in ("1", "true"):
                        styles.add(style)
                if pr.get("u") not in (None, "none"):
                    styles.add("underline")
                if pr.get("strike") not in (None, "noStrike"):
                    styles.add("strikethrough")
                base = number(pr.get("baseline"))
                if base:
                    styles.add("superscript" if base > 0 else "subscript")
                link = pr.child("hlinkClick")
            rel = self.rels.get(link.get("id", "")) if link is not None else None
            if rel is not None and rel["external"]:
                self.runs.end()
                self.out.begin("link", url=rel["target"], title="")
                self.runs.text(r.child("t").text(), styles - {"underline"})
                self.runs.end()
                self.out.end()
            else:
                self.runs.text(r.child("t").text(), styles)

    def table(self, t: Element) -> None:
        out = self.out
        grid = t.child("tblGrid")
        first = t.child("tblPr") is not None and t.child("tblPr").get("firstRow") in ("1", "true")
        rows = t.children("tr")
        if not rows:
            return
        out.open("table", alignments=["default"] * max(1, len(grid.children("gridCol")) if grid else 1))
        for k, r in enumerate(rows):
            if k == 0 or (k == 1 and first):
                if k:
                    out.close()
                out.open("table_head" if first and k == 0 else "table_body")
            out.open("table_row")
            for c in r.children("tc"):
                if c.get("hMerge") in ("1", "true") or c.get("vMerge") in ("1", "true"):
                    out.report("pptx.merged-cells", "note", loss="structural")
                    if c.get("vMerge") not in ("1", "true"):
                        continue
                out.open("table_cell", alignment="default", row_span=1, col_span=max(1, number(c.get("gridSpan"), 1)))
                if c.child("txBody") is not None and c.get("vMerge") not in ("1", "true"):
                    self.text_body(c.child("txBody"), None)
                out.close()
            out.close()
        out.close()
        out.close()

    def picture(self, s: Element) -> None:
        blip = next((x for x in s.walk() if x.tag == "blip"), None)
        rel = self.rels.get((blip.get("embed") or blip.get("link") or "") if blip is not None else "")
        if rel is None:
            return
        info = next((x for x in s.walk() if x.tag == "cNvPr"), None)
        alt = (info.get("descr") or info.get("name") or "") if info is not None else ""
        content = None if rel["external"] else self.pkg.read(rel["target"])
        mime = MIMES.get(rel["target"].rsplit(".", 1)[-1].lower(), "application/octet-stream")
        self.out.open("paragraph")
        self.out.begin("image", url=rel["target"], title="", resource=self.out.resource(rel["target"], content, mime, alt))
        self.out.text(alt)
        self.out.end()
        self.out.close()


def read(content: bytes, name: str = "", limits: Limits = DEFAULT) -> Document:
    pkg, out = Package(content, limits, "pptx"), Builder(limits)
    main = next((r["target"] for r in pkg.relationships("").values() if r["type"] == "officeDocument"), "ppt/presentation.xml")
    deck = pkg.xml(main)
    if deck is None:
        raise Refused("pptx.missing-presentation")
    out.report("pptx.presentation-projection", "note", loss="presentation")
    rels = pkg.relationships(main)
    for k, s in enumerate(deck.child("sldIdLst").children("sldId") if deck.child("sldIdLst") else ()):
        rel = next((rels[v] for a, v in s.attrs.items() if v in rels), None)
        root = pkg.xml(rel["target"]) if rel else None
        if root is None:
            continue
        slide = _Slide(pkg, out, rel["target"])
        tree = root.child("cSld", "spTree")
        if tree is not None:
            slide.shapes(tree, k)
        notes = next((r["target"] for r in slide.rels.values() if r["type"] == "notesSlide"), None)
        page = pkg.xml(notes) if notes else None
        tree = page.child("cSld", "spTree") if page else None
        if tree is not None and any(x.tag == "t" and x.text().strip() for x in tree.walk()):
            node = out.open("container", attrs={"classes": ["notes"]})
            _Slide(pkg, out, notes).shapes(tree, k, notes=True)
            out.close()
            if not node.kids:
                out.blocks[-1][1].pop()
    return out.doc
