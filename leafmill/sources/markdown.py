"""Markdown: a CommonMark subset with tables, strikethrough and footnotes.

Blocks first, by recursive descent over lines: a quote or list item collects its lines, without their prefix, and
parses them as a document of their own.  Inlines of all leaves follow, when link references and footnote labels
are known; references are looked up in a dictionary of the document.
"""

from __future__ import annotations

import re

from leafmill.functions.limits import DEFAULT, LimitExceeded, Limits
from leafmill.functions.tree import Builder, Document, Refused

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^\n]*)$")
_BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r" {0,3}>[ ]?")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?=[ \t]|$)")
_HTML = re.compile(r" {0,3}<[A-Za-z/!?]")
_NOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*")
_REFERENCE = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(<[^<>\n]*>|\S+)(?:[ \t]+(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*$")
_DELIMITER_CELL = re.compile(r":?-+:?$")
_PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>")
_MAIL = re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+)>")
_RAW = re.compile(r"<(?:/?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?|!--.*?--|\?.*?\?|![A-Z][^>]*)>", re.S)
_ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,6})|#([0-9]{1,7})|([A-Za-z]+));")
# The only names that this format's text decodes.
NAMES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "\u00a9", "reg": "\u00ae", "trade": "\u2122", "hellip": "\u2026", "mdash": "\u2014", "ndash": "\u2013", "lsquo": "\u2018", "rsquo": "\u2019",
    "ldquo": "\u201c", "rdquo": "\u201d", "bull": "\u2022", "middot": "\u00b7", "times": "\u00d7", "deg": "\u00b0", "para": "\u00b6", "sect": "\u00a7", "euro": "\u20ac", "pound": "\u00a3", "yen": "\u00a5", "laquo": "\u00ab", "raquo": "\u00bb",
}


def expand(line: str) -> str:
    """Leading tabs to stops of four columns."""
    bare = line.lstrip(" \t")
    lead = line[: len(line) - len(bare)]
    return lead.expandtabs(4) + bare if "\t" in lead else line


def label(s: str) -> str:
    return re.sub(r"[ \t\r\n]+", " ", s.strip(" \t\r\n")).translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def unescape(s: str) -> str:
    return decode(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", s))


def decode(s: str) -> str:
    def one(m: re.Match) -> str:
        hexa, dec, name = m.groups()
        if name:
            return NAMES.get(name, m.group())
        n = int(hexa, 16) if hexa else int(dec)
        return "�" if n == 0 or n > 0x10FFFF or 0xD800 <= n < 0xE000 else chr(n)

    return _ENTITY.sub(one, s) if "&" in s else s


def row_cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    cells, cell, i = [], "", 0
    while i < len(line):
        c = line[i]
        if c == "\\" and i + 1 < len(line):
            cell += "|" if line[i + 1] == "|" else line[i : i + 2]
            i += 2
            continue
        if c == "|":
            cells.append(cell.strip())
            cell = ""
        else:
            cell += c
        i += 1
    if cell.strip() or not line.endswith("|"):
        cells.append(cell.strip())
    return cells


def delimiter_row(line: str) -> list[str] | None:
    if "-" not in line or not set(line) <= set("|:- \t"):
        return None
    cells = row_cells(line)
    if not cells or not all(_DELIMITER_CELL.match(c) for c in cells):
        return None
    return [{(True, True): "center", (True, False): "left", (False, True): "right"}.get((c[0] == ":", c[-1] == ":"), "default") for c in cells]


class _Blocks:
    """Lines -> plain tuples; leaves keep their source text until references are known."""

    def __init__(self, limits: Limits):
        self.limits, self.refs, self.notes = limits, {}, {}

    def parse(self, lines: list[str], depth: int = 0) -> list[tuple]:
        if depth > self.limits.max_depth:
            raise LimitExceeded("max_depth")
        out: list[tuple] = []
        para: list[str] = []

        def flush() -> None:
            rest = para[:]
            para.clear()
            while rest:
                m = _REFERENCE.match(rest[0])
                if not m or m.group(1).startswith("^"):
                    break
                url, title = m.group(2), m.group(3)
                self.refs.setdefault(label(m.group(1)), (unescape(url[1:-1] if url.startswith("<") else url), unescape(title[1:-1]) if title else ""))
                rest.pop(0)
            if rest:
                out.append(("paragraph", "\n".join(x.lstrip(" \t") for x in rest)))

        i = 0
        while i < len(lines):
            line = expand(lines[i])
            if not line.strip(" \t"):
                flush()
                i += 1
                continue
            indent = len(line) - len(line.lstrip(" "))
            if indent >= 4 and not para:
                j, code = i, []
                while j < len(lines):
                    x = expand(lines[j])
                    if x.strip(" \t") and not x.startswith("    "):
                        break
                    code.append(x[4:])
                    j += 1
                while code and not code[-1].strip(" \t"):
                    code.pop()
                    j -= 1
                out.append(("code", "", "\n".join(code) + "\n"))
                i = j
                continue
            if indent >= 4:
                para.append(line)
                i += 1
                continue
            if _QUOTE.match(line):
                flush()
                i, inner = self.collect_quote(lines, i)
                out.append(("quote", self.parse(inner, depth + 1)))
                continue
            m = _NOTE.match(line)
            if m:
                flush()
                i = self.collect_note(lines, i, m, depth)
                continue
            m = _ITEM.match(line)
            if m and (not para or (line[m.end() :].strip() and (m.group(2) in "-+*" or m.group(2)[:-1] == "1"))):
                flush()
                i, item = self.list(lines, i, depth)
                out.append(item)
                continue
            m = _ATX.match(line)
            if m:
                flush()
                out.append(("heading", len(m.group(1)), (m.group(2) or "").strip(" \t") if set(m.group(2) or "") != {"#"} else ""))
                i += 1
                continue
            m = _FENCE.match(line)
            if m and not (m.group(2)[0] == "`" and "`" in m.group(3)):
                flush()
                i = self.fence(lines, i, m, out)
                continue
            m = _SETEXT.match(line)
            if m and para:
                text = [x.strip(" \t") for x in para]
                para.clear()
                out.append(("heading", 1 if m.group(1)[0] == "=" else 2, "\n".join(text)))
                i += 1
                continue
            columns = delimiter_row(line) if len(para) == 1 and "|" in para[0] else None
            if columns:
                i = self.table(lines, i, para.pop(), columns, out)
                continue
            if _BREAK.match(line):
                flush()
                out.append(("break",))
                i += 1
                continue
            if _HTML.match(line) and not para:
                j = i
                while j < len(lines) and lines[j].strip(" \t"):
                    j += 1
                out.append(("raw", "\n".join(lines[i:j]) + "\n"))
                i = j
                continue
            para.append(line)
            i += 1
        flush()
        return out

    def starts_block(self, line: str) -> bool:
        x = expand(line)
        return bool(not x.strip(" \t") or _QUOTE.match(x) or _ITEM.match(x) or _ATX.match(x) or _FENCE.match(x) or _BREAK.match(x) or _HTML.match(x) or _NOTE.match(x))

    @staticmethod
    def may_be_lazy(last: str) -> bool:
        """Could the line before end inside a paragraph?"""
        x = expand(last)
        while True:
            m = _QUOTE.match(x) or _ITEM.match(x)
            if not m:
                break
            x = x[m.end() :].lstrip(" ")
        return bool(x.strip(" \t")) and not (_ATX.match(x) or _FENCE.match(x) or _BREAK.match(x))

    def collect_quote(self, lines: list[str], i: int) -> tuple[int, list[str]]:
        inner: list[str] = []
        fenced = None
        while i < len(lines):
            line = expand(lines[i])
            m = _QUOTE.match(line)
            if m:
                inner.append(line[m.end() :])
                f = _FENCE.match(inner[-1])
                if f:
                    fenced = None if fenced and f.group(2).startswith(fenced) else fenced or f.group(2)
            elif inner and not fenced and not self.starts_block(line) and self.may_be_lazy(inner[-1]):
                inner.append(line)
            else:
                break
            i += 1
        return i, inner

    def collect_note(self, lines: list[str], i: int, m: re.Match, depth: int) -> int:
        inner = [expand(lines[i])[m.end() :]]
        i += 1
        while i < len(lines):
            line = expand(lines[i])
            if not line.strip(" \t"):
                if i + 1 < len(lines) and expand(lines[i + 1]).startswith("    "):
                    inner.append("")
                    i += 1
                    continue
                break
            if line.startswith("    "):
                inner.append(line[4:])
            elif not self.starts_block(line) and inner[-1].strip():
                inner.append(line)
            else:
                break
            i += 1
        key = label(m.group(1))
        if key not in self.notes:
            self.notes[key] = self.parse(inner, depth + 1)
        return i

    def list(self, lines: list[str], i: int, depth: int) -> tuple[int, tuple]:
        first = _ITEM.match(expand(lines[i]))
        sign = first.group(2)[-1]
        start = int(first.group(2)[:-1]) if len(first.group(2)) > 1 else None
        items: list[list[str]] = []
        loose = False
        blank = False
        while i < len(lines):
            line = expand(lines[i])
            m = _ITEM.match(line)
            if not m or m.group(2)[-1] != sign:
                break
            if blank:
                loose = True
            rest = line[m.end() :]
            gap = len(rest) - len(rest.lstrip(" "))
            width = m.end() + (1 if not rest.strip() or gap > 4 else gap)
            inner = [line[min(width, len(line)) :] if rest.strip() else ""]
            i += 1
            blank, fenced = False, None
            held: list[str] = []
            while i < len(lines):
                x = expand(lines[i])
                if not x.strip(" \t"):
                    held.append("")
                    i += 1
                    continue
                if x.startswith(" " * width):
                    if held and not inner[0].strip() and len(inner) == 1:
                        break  # an item may begin with one blank line at most
                    inner += [*held, x[width:]]
                    held = []
                elif not held and not fenced and not self.starts_block(x) and self.may_be_lazy(inner[-1]):
                    inner.append(x)
                else:
                    break
                f = _FENCE.match(inner[-1])
                if f:
                    fenced = None if fenced and f.group(2).startswith(fenced) else fenced or f.group(2)
                i += 1
            blank = bool(held)
            items.append(inner)
        parsed = []
        for inner in items:
            blocks = self.parse(inner, depth + 1)
            parsed.append(blocks)
            loose = loose or self.apart(inner, blocks)
        return i, ("list", start, "paren" if sign == ")" else "period", loose, parsed)

    @staticmethod
    def apart(lines: list[str], blocks: list[tuple]) -> bool:
        """A blank line before a later paragraph of the item itself."""
        if sum(b[0] == "paragraph" for b in blocks) == 0 or len(blocks) < 2:
            return False
        fenced = None
        for a, b in zip(lines, lines[1:], strict=False):
            f = _FENCE.match(a)
            if f:
                fenced = None if fenced and f.group(2).startswith(fenced) else fenced or f.group(2)
            if not fenced and not a.strip(" \t") and b.strip(" \t") and not b.startswith((" ", "\t")) and not (_ITEM.match(b) or _FENCE.match(b) or _ATX.match(b) or _QUOTE.match(b) or _BREAK.match(b)):
                return True
        return False

    def fence(self, lines: list[str], i: int, m: re.Match, out: list[tuple]) -> int:
        indent, mark, info = len(m.group(1)), m.group(2), unescape(m.group(3).strip(" \t"))
        body: list[str] = []
        i += 1
        while i < len(lines):
            x = expand(lines[i])
            c = re.match(r" {0,3}(`{3,}|~{3,})[ \t]*$", x)
            i += 1
            if c and c.group(1)[0] == mark[0] and len(c.group(1)) >= len(mark):
                break
            lead = len(x) - len(x.lstrip(" "))
            body.append(x[min(indent, lead) :] if indent else lines[i - 1])
        out.append(("code", info.split()[0] if info.split() else "", "".join(b + "\n" for b in body)))
        return i

    def table(self, lines: list[str], i: int, head: str, columns: list[str], out: list[tuple]) -> int:
        rows = []
        i += 1
        while i < len(lines):
            line = expand(lines[i])
            if not line.strip(" \t") or (self.starts_block(line) and not line.lstrip().startswith("|")):
                break
            cells = row_cells(line)[: len(columns)]
            rows.append(cells + [""] * (len(columns) - len(cells)))
            i += 1
        cells = row_cells(head)[: len(columns)]
        out.append(("table", columns, cells + [""] * (len(columns) - len(cells)), rows))
        return i


class _Inlines:
    """Scans a leaf into a flat list, then pairs delimiters and brackets."""

    def __init__(self, refs: dict, notes: dict, emit_note):
        self.refs, self.notes, self.emit_note = refs, notes, emit_note

    def parse(self, s: str) -> list[tuple]:
        items: list[list] = []  # [kind, ...]; delimiters: ["delim", char, count, opens, closes]
        brackets: list[tuple[int, bool, bool]] = []  # item number, image, alive
        i, n, buf = 0, len(s), []

        def flush() -> None:
            if buf:
                items.append(["text", "".join(buf)])
                buf.clear()

        while i < n:
            c = s[i]
            if c == "\\" and i + 1 < n:
                if s[i + 1] == "\n":
                    flush()
                    items.append(["hard"])
                    i += 2
                    while i < n and s[i] == " ":
                        i += 1
                    continue
                if s[i + 1] in _PUNCTUATION:
                    buf.append(s[i + 1])
                    i += 2
                    continue
            elif c == "\n":
                spaces = len("".join(buf)) - len("".join(buf).rstrip(" "))
                text = "".join(buf).rstrip(" ")
                buf[:] = [text] if text else []
                flush()
                items.append(["hard" if spaces >= 2 else "soft"])
                i += 1
                while i < n and s[i] == " ":
                    i += 1
                continue
            elif c == "`":
                run = len(s[i:]) - len(s[i:].lstrip("`"))
                m = re.compile(r"(?<!`)`{%d}(?!`)" % run).search(s, i + run)
                if m:
                    flush()
                    code = s[i + run : m.start()].replace("\n", " ")
                    if code.startswith(" ") and code.endswith(" ") and code.strip(" "):
                        code = code[1:-1]
                    items.append(["code", code])
                    i = m.end()
                    continue
                buf.append("`" * run)
                i += run
                continue
            elif c in "*_~":
                run = len(s[i:]) - len(s[i:].lstrip(c))
                before, after = s[i - 1] if i else "\n", s[i + run] if i + run < n else "\n"
                left = not after.isspace() and (after not in _PUNCTUATION or before.isspace() or before in _PUNCTUATION)
                right = not before.isspace() and (before not in _PUNCTUATION or after.isspace() or after in _PUNCTUATION)
                if c == "~":
                    opens, closes = (left, right) if run == 2 else (False, False)
                elif c == "*":
                    opens, closes = left, right
                else:
                    opens, closes = left and (not right or before in _PUNCTUATION), right and (not left or after in _PUNCTUATION)
                flush()
                items.append(["delim", c, run, opens, closes])
                i += run
                continue
            elif c == "!" and s[i + 1 : i + 2] == "[":
                flush()
                brackets.append((len(items), True, True))
                items.append(["text", "!["])
                i += 2
                continue
            elif c == "[":
                m = re.compile(r"\[\^([^\]\s]+)\]").match(s, i)
                if m and label(m.group(1)) in self.notes:
                    flush()
                    items.append(["note", label(m.group(1))])
                    i = m.end()
                    continue
                flush()
                brackets.append((len(items), False, True))
                items.append(["text", "["])
                i += 1
                continue
            elif c == "]":
                flush()
                if not brackets:
                    buf.append("]")
                    i += 1
                    continue
                at, image, alive = brackets.pop()
                found = self.link_target(s, i, s, at, items) if alive else None
                if found is None:
                    buf.append("]")
                    i += 1
                    continue
                url, title, i = found
                inner = self.pair(items[at + 1 :])
                del items[at:]
                items.append(["image" if image else "link", url, title, inner])
                if not image:
                    brackets = [(a, im, alive and im) for a, im, alive in brackets]
                continue
            elif c == "<":
                m = _AUTOLINK.match(s, i) or _MAIL.match(s, i)
                if m:
                    flush()
                    items.append(["link", ("mailto:" if m.re is _MAIL else "") + m.group(1), "", [("text", m.group(1))]])
                    i = m.end()
                    continue
                m = _RAW.match(s, i)
                if m:
                    flush()
                    items.append(["raw", m.group()])
                    i = m.end()
                    continue
            elif c == "&":
                m = _ENTITY.match(s, i)
                if m:
                    buf.append(decode(m.group()))
                    i = m.end()
                    continue
            buf.append(c)
            i += 1
        flush()
        return self.pair(items)

    def link_target(self, s: str, i: int, _s: str, at: int, items: list) -> tuple[str, str, int] | None:
        m = re.compile(r"\([ \t\n]*(?:<((?:[^<>\n\\]|\\.)*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:[ \t\n]+(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t\n]*\)").match(s, i + 1)
        if m:
            return unescape(m.group(1) if m.group(1) is not None else m.group(2)), unescape(m.group(3)[1:-1]) if m.group(3) else "", m.end()
        m = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(s, i + 1)
        own = label(self.source_of(s, i))
        if m and label(m.group(1)) and label(m.group(1)) in self.refs:
            return *self.refs[label(m.group(1))], m.end()
        if own in self.refs:
            return *self.refs[own], m.end() if m and not label(m.group(1)) else i + 1
        return None

    @staticmethod
    def source_of(s: str, i: int) -> str:
        depth, j = 0, i - 1
        while j >= 0:
            if s[j] == "]" and s[j - 1 : j] != "\\":
                depth += 1
            elif s[j] == "[" and s[j - 1 : j] != "\\":
                if not depth:
                    return s[j + 1 : i]
                depth -= 1
            j -= 1
        return ""

    @staticmethod
    def pair(items: list[list]) -> list[tuple]:
        """Emphasis by the delimiter rules, the rule of three included."""
        nodes: list = [list(x) for x in items]
        k = 0
        while k < len(nodes):
            x = nodes[k]
            if x[0] != "delim" or not x[4] or not x[2]:
                k += 1
                continue
            j = k - 1
            while j >= 0:
                y = nodes[j]
                if y[0] == "delim" and y[1] == x[1] and y[3] and y[2]:
                    odd = (x[3] or y[4]) and (y[2] + x[2]) % 3 == 0 and (y[2] % 3 or x[2] % 3)
                    if not (x[1] != "~" and odd):
                        break
                j -= 1
            if j < 0:
                k += 1
                continue
            y = nodes[j]
            use = 2 if x[2] >= 2 and y[2] >= 2 else 1
            kind = "strikethrough" if x[1] == "~" else "strong" if use == 2 else "emphasis"
            inner = [z if z[0] != "delim" else ["text", z[1] * z[2]] for z in nodes[j + 1 : k]]
            y[2] -= use
            x[2] -= use
            nodes[j + 1 : k] = [[kind, [tuple(z) for z in inner if z != ["text", ""]]]]
            k = j + 2
            if not y[2]:
                del nodes[j]
                k -= 1
        return [tuple(z) if z[0] != "delim" else ("text", z[1] * z[2]) for z in nodes if z[0] != "delim" or z[2]]


class _Emit:
    def __init__(self, out: Builder, blocks: _Blocks):
        self.out, self.numbers = out, {}
        self.source = blocks.notes
        self.inline = _Inlines(blocks.refs, blocks.notes, None)

    def blocks(self, blocks: list[tuple], tight: bool = False) -> None:
        out = self.out
        for b in blocks:
            kind = b[0]
            if kind == "paragraph":
                out.open("plain" if tight else "paragraph")
                self.leaf(b[1])
                out.close()
            elif kind == "heading":
                out.open("heading", level=b[1])
                self.leaf(b[2])
                out.close()
            elif kind == "code":
                out.leaf("code_block", text=b[2], attrs={"classes": [b[1]]} if b[1] else None)
            elif kind == "raw":
                out.leaf("raw_block", text=b[1], format="html")
            elif kind == "break":
                out.leaf("thematic_break")
            elif kind == "quote":
                out.open("quote")
                self.blocks(b[1])
                out.close()
            elif kind == "list":
                _, start, delimiter, loose, items = b
                out.open("list", kind="unordered" if start is None else "ordered", start=1 if start is None else start, style="decimal", delimiter=delimiter)
                for item in items:
                    out.open("list_item")
                    self.blocks(item, not loose)
                    out.close()
                out.close()
            else:
                self.table(*b[1:])

    def table(self, columns: list[str], head: list[str], rows: list[list[str]]) -> None:
        out = self.out
        out.open("table", alignments=columns)
        for section, part in (("table_head", [head]), ("table_body", rows)):
            if not part:
                continue
            out.open(section)
            for row in part:
                out.open("table_row")
                for text in row:
                    out.open("table_cell", alignment="default", row_span=1, col_span=1)
                    out.open("plain")
                    self.leaf(text)
                    out.close()
                    out.close()
                out.close()
            out.close()
        out.close()

    def leaf(self, text: str) -> None:
        self.inlines(self.inline.parse(text.strip(" \t")))

    def inlines(self, items: list[tuple]) -> None:
        out = self.out
        for x in items:
            kind = x[0]
            if kind == "text":
                out.text(x[1])
            elif kind == "soft":
                out.soft_break()
            elif kind == "hard":
                out.hard_break()
            elif kind == "code":
                out.inline("code", text=x[1])
            elif kind == "raw":
                out.inline("raw", text=x[1], format="html")
            elif kind == "note":
                self.note(x[1])
            elif kind in ("link", "image"):
                out.begin(kind, url=x[1], title=x[2])
                self.inlines(x[3])
                out.end()
            else:
                out.begin(kind)
                self.inlines(x[1])
                out.end()

    def note(self, key: str) -> None:
        out = self.out
        if key not in self.numbers:
            self.numbers[key] = len(self.numbers)
            n = out.note()
            self.numbers[key] = n
            self.blocks(self.source[key])
            out.end_note()
        out.inline("note", note=self.numbers[key])


def read(content: bytes, name: str = "", limits: Limits = DEFAULT) -> Document:
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as e:
        raise Refused("markdown.invalid-utf8") from e
    blocks = _Blocks(limits)
    parsed = blocks.parse(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    out = Builder(limits)
    _Emit(out, blocks).blocks(parsed)
    return out.doc
