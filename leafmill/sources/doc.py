"""DOC: main text through the piece table, headings by paragraph style."""

from __future__ import annotations

import re
import struct
from bisect import bisect_right

from leafmill.functions.limits import DEFAULT, Limits
from leafmill.functions.tree import Builder, Document, Refused
from leafmill.sources.compound import Compound
from leafmill.sources.docx import hyperlink_target


class Styles:
    """Paragraph style of a file offset: page of the bin table, then run in the page."""

    def __init__(self, word: bytes, table: bytes):
        self.word, self.names, self.levels = word, {}, {}
        self.starts: list[int] = []
        self.pages: list[int] = []
        try:
            self._sheet(table, *struct.unpack_from("<II", word, 0xA2))
            fc, n = struct.unpack_from("<II", word, 0x102)
            count = (n - 4) // 8
            self.starts = list(struct.unpack_from(f"<{count + 1}I", table, fc)) if count > 0 else []
            self.pages = list(struct.unpack_from(f"<{count}I", table, fc + 4 * (count + 1))) if count > 0 else []
        except struct.error:
            self.starts, self.pages = [], []

    def _sheet(self, table: bytes, fc: int, n: int) -> None:
        if n < 20 or fc + n > len(table):
            return
        size, count, base = struct.unpack_from("<HHH", table, fc)
        at = fc + 2 + size
        for i in range(count):
            length, = struct.unpack_from("<H", table, at)
            at += 2
            if length >= base + 2:
                sti, kind = struct.unpack_from("<HH", table, at)
                chars, = struct.unpack_from("<H", table, at + base)
                name = table[at + base + 2 : at + base + 2 + 2 * chars].decode("utf-16-le", "replace")
                if kind & 15 == 1:
                    m = re.fullmatch(r"heading ([1-9])", name, re.I)
                    self.names[i] = name
                    if 1 <= sti & 0xFFF <= 9:
                        self.levels[i] = sti & 0xFFF
                    elif m:
                        self.levels[i] = int(m.group(1))
            at += length + (length & 1)

    def of(self, fc: int) -> int | None:
        k = bisect_right(self.starts, fc) - 1
        if not 0 <= k < len(self.pages):
            return None
        page = self.word[(self.pages[k] & 0x3FFFFF) * 512 :][:512]
        if len(page) < 512:
            return None
        runs = page[511]
        bounds = struct.unpack_from(f"<{runs + 1}I", page, 0) if 4 * (runs + 1) < 512 else ()
        r = bisect_right(bounds, fc) - 1
        if not 0 <= r < runs:
            return None
        offset = page[4 * (runs + 1) + 13 * r] * 2
        if not offset or offset + 4 > 512:
            return 0
        words = page[offset]
        at = offset + 1 if words else offset + 2
        return struct.unpack_from("<H", page, at)[0] if at + 2 <= 512 else None


def pieces(word: bytes, table: bytes, flags: int) -> list[tuple[int, int, bool]]:
    """(characters, file offset, one byte a character)."""
    fc, n = struct.unpack_from("<II", word, 0x1A2)
    try:
        clx = table[fc : fc + n]
        at = 0
        while n and clx[at] == 1:
            at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
        if n and clx[at] == 2:
            size, = struct.unpack_from("<I", clx, at + 1)
            count = (size - 4) // 12
            cps = struct.unpack_from(f"<{count + 1}I", clx, at + 5)
            out = []
            for i in range(count):
                raw, = struct.unpack_from("<I", clx, at + 5 + 4 * (count + 1) + 8 * i + 2)
                small = bool(raw & 0x40000000)
                out.append((cps[i + 1] - cps[i], (raw & 0x3FFFFFFF) // 2 if small else raw & 0x3FFFFFFF, small))
            if all(c >= 0 for c, _, _ in out):
                return out
    except (struct.error, IndexError):
        pass
    low, high = struct.unpack_from("<II", word, 24)
    wide = bool(flags & 0x1000)
    return [((high - low) // (2 if wide else 1), low, not wide)] if high > low else []


def read(content: bytes, name: str = "", limits: Limits = DEFAULT) -> Document:
    box, out = Compound(content, "doc"), Builder(limits)
    word = box.stream("WordDocument")
    if word is None or len(word) < 0x1AA:
        raise Refused("doc.missing-word-stream")
    magic, _, _, _, _, flags = struct.unpack_from("<HHHHHH", word, 0)
    if magic != 0xA5EC:
        raise Refused("doc.unsupported-version")
    if flags & 0x0100:
        raise Refused("doc.encryption-refused")
    table = box.stream("1Table" if flags & 0x0200 else "0Table") or b""
    left, = struct.unpack_from("<I", word, 0x4C)
    styles = Styles(word, table)
    counts = {"tables-flattened": 0, "page-breaks-dropped": 0, "embedded-objects-dropped": 0}
    fields: list[dict] = []
    start: int | None = None

    def ensure(fc: int) -> None:
        if out.in_leaf:
            return
        style = styles.of(start if start is not None else fc)
        level = styles.levels.get(style, 0) if style is not None else 0
        node = out.open("heading", level=min(level, 6)) if level else out.open("paragraph")
        if style is not None and styles.names.get(style) and styles.names[style] != "Normal":
            out.facet(node, "style", name=styles.names[style])
        if level:
            out.facet(node, "provenance", plugin="doc", member="WordDocument", byte_start=start or fc, byte_len=0, confidence="exact")

    def end() -> None:
        nonlocal start
        for f in fields:
            if f["link"]:
                out.end()
                f["link"] = False
        if out.in_leaf:
            node = out.close()
            if not node.kids:
                out.blocks[-1][1].pop()
        start = None

    for n, fc, small in pieces(word, table, flags):
        n = min(n, left)
        left -= n
        raw = word[fc : fc + n * (1 if small else 2)]
        text = raw.decode("cp1252", "replace") if small else raw.decode("utf-16-le", "replace")
        step = 1 if small else 2
        for m in re.finditer("[^\x00-\x1f]+|[\x00-\x1f]", text):
            s, at = m.group(), fc + m.start() * step
            if start is None and not out.in_leaf:
                start = at
            hidden = any(f["code"] for f in fields)
            if s == "\x13":
                fields.append({"code": True, "instr": "", "link": False})
            elif s == "\x14" and fields:
                f = fields[-1]
                f["code"] = False
                url = hyperlink_target(f["instr"])
                if url is not None and len(fields) == 1:
                    ensure(at)
                    out.begin("link", url=url, title="")
                    f["link"] = True
            elif s == "\x15" and fields:
                if fields.pop()["link"]:
                    out.end()
            elif hidden:
                fields[-1]["instr"] += s
            elif s == "\r":
                end()
            elif s == "\x07":
                counts["tables-flattened"] += 1
                end()
            elif s == "\x0c":
                counts["page-breaks-dropped"] += 1
                end()
            elif s == "\x0b":
                if out.in_leaf:
                    out.hard_break()
            elif s == "\t":
                if out.in_leaf:
                    out.space()
            elif s in ("\x01", "\x08"):
                counts["embedded-objects-dropped"] += 1
            elif s == "\x1e":
                ensure(at)
                out.text("-")
            elif s >= " ":
                if s.strip() or out.in_leaf:
                    ensure(at)
                    out.text(s)
    end()
    if not styles.starts:
        out.report("doc.styles-omitted", "note", loss="structural")
    for what, k in counts.items():
        if k:
            out.report(f"doc.{what}", "note", loss={"tables-flattened": "structural", "embedded-objects-dropped": "dropped"}.get(what, "presentation"), count=k)
    return out.doc
