"""Markdown from a document tree: deterministic, minimal escaping, losses counted by rule."""

from __future__ import annotations

import re
from collections import Counter

from .tree import Document, Node

#: Rule -> (content, structure, presentation) cost of one use.
RULES = {
    "style-dropped": (0, 0, 1), "extension-fallback": (0, 0, 1), "citation-dropped": (0, 0, 1), "raw-dropped": (1, 0, 0), "nested-table": (1, 0, 0), "cell-flattened": (0, 1, 0),
    "cell-span": (0, 1, 0), "number-style": (0, 0, 1), "definition-list": (0, 1, 0), "container-attrs": (0, 0, 1), "table-caption": (0, 1, 0),
}
#: Rule -> the code that its uses are reported under.
CODES = {
    "style-dropped": "markdown.style-dropped", "extension-fallback": "markdown.extension-fallback", "citation-dropped": "markdown.citation-dropped", "raw-dropped": "markdown.raw-dropped", "nested-table": "markdown.nested-table-dropped", "cell-flattened": "markdown.table-cell-flattened",
    "cell-span": "markdown.cell-span-degraded", "number-style": "markdown.list-number-style-degraded", "definition-list": "markdown.definition-list-degraded", "container-attrs": "markdown.container-attributes-dropped", "table-caption": "markdown.table-caption-degraded",
}
_DELIMITERS = {"emphasis": "_", "strong": "**", "strikethrough": "~~"}
#: Inlines that a run of words is made of, and what blanks are.
_BLANK_OF = {"text": "", "space": " ", "soft_break": "\n"}
_PLAIN = frozenset(_BLANK_OF)
_DROPPED_STYLES = frozenset({"underline", "small_caps", "superscript", "subscript"})
_ENTITY = re.compile(r"&(#?)[A-Za-z0-9]+;")
_SPECIAL = re.compile(r"[\\`*\[\]_#>+\-!|<&]")
_BREAKING = re.compile(r"[\n\r\t]+")
#: Signs at the end of a heading that would be taken for its closing sequence.
_CLOSING = re.compile(r"(?:(?<= )|^)(#+)$")
MAX_PAD = 30


def _alnum(c: str) -> bool:
    return c.isascii() and c.isalnum()


def escape(text: str, line_start: bool, cell: bool, lines: bool = False) -> str:
    """lines: each line of the text begins one, not its first alone."""
    if not _SPECIAL.search(text):
        return text
    out, last = [], 0
    for m in _SPECIAL.finditer(text):
        c, i = m.group(), m.start()
        if c in "\\`*[]<":
            hit = True
        elif c == "_":
            hit = not (i and _alnum(text[i - 1]) and i + 1 < len(text) and _alnum(text[i + 1]))
        elif c in "#>+-":
            hit = line_start if i == 0 else lines and text[i - 1] == "\n"
        elif c == "!":
            hit = text[i + 1 : i + 2] == "["
        elif c == "|":
            hit = cell
        else:
            hit = bool(_ENTITY.match(text, i))
        if hit:
            out.append(text[last:i] + "\\")
            last = i
    out.append(text[last:])
    return "".join(out)


def _longest(text: str, char: str) -> int:
    return max((len(x) for x in re.findall(re.escape(char) + "+", text)), default=0)


def target(url: str, title: str) -> str:
    if any(c in url for c in " <>\n"):
        url = f"<{url}>"
    else:
        url = url.replace("(", "\\(").replace(")", "\\)")
    return f"]({url}" + (f' "{title.replace(chr(34), chr(92) + chr(34))}"' if title else "") + ")"


def flattens(cell: Node) -> bool:
    return len(cell.kids) > 1 or any(k.tag not in ("paragraph", "plain") for k in cell.kids)


class Writer:
    def __init__(self, doc: Document):
        self.doc, self.hits, self.lines = doc, Counter(), []
        self.notes: list[int] = []
        self.urls: dict[int, str] = {}

    # ------------------------------------------------------------- inlines
    def inlines(self, kids: list[Node], mode: str, before: str = "") -> str:
        """mode: multiline, line or cell.  before: what stands before on the line, for escapes at its start."""
        out = before
        if len(kids) > 2:
            tags = [k.tag for k in kids]
            if _PLAIN.issuperset(tags) and "texttext" not in "".join(tags):
                text = "".join([_BLANK_OF[k.tag] or k.text for k in kids])
                many = mode == "multiline"
                if text.count("\n") == tags.count("soft_break"):  # what escapes look at never reaches past a blank
                    return before + escape(text if many else text.replace("\n", " "), not before or before[-1] == "\n", mode == "cell", many)
        for k in kids:
            t = k.tag
            if t == "text":
                out += escape(k.text, not out or out[-1] == "\n", mode == "cell")
            elif t == "space":
                out += " "
            elif t == "soft_break":
                out += "\n" if mode == "multiline" else " "
            elif t == "hard_break":
                out += "\\\n" if mode == "multiline" else " "
            elif t in _DELIMITERS:
                out = self._styled(out, k, _DELIMITERS[t], mode)
            elif t in ("link", "image"):
                url = self.urls.get(k.p.get("resource"), k.p.get("url") or "") if k.p.get("resource") is not None else k.p.get("url") or ""
                out = self.inlines(k.kids, mode, out + ("[" if t == "link" else "![")) + target(url, k.p.get("title") or "")
            elif t == "code":
                fence = "`" * (_longest(k.text, "`") + 1)
                pad = " " if not k.text or k.text[0] in "` " or k.text[-1] in "` " else ""
                out += fence + pad + (k.text.replace("|", "\\|") if mode == "cell" else k.text) + pad + fence
            elif t == "math":
                mark = "$$" if k.p.get("kind") == "display" else "$"
                out += mark + k.text + mark
            elif t == "raw":
                if k.p.get("format") in ("markdown", "html"):
                    out += k.text
                else:
                    self.hits["raw-dropped"] += 1
            elif t == "note":
                n = k.p["note"]
                if n not in self.notes:
                    self.notes.append(n)
                out += f"[^{self.notes.index(n) + 1}]"
            elif t == "quote":
                mark = "'" if k.p.get("kind") == "single" else '"'
                out = self.inlines(k.kids, mode, out + mark) + mark
            else:
                if t in _DROPPED_STYLES:
                    self.hits["style-dropped"] += 1
                elif t == "extension":
                    self.hits["extension-fallback"] += 1
                elif t == "citation":
                    self.hits["citation-dropped"] += 1
                out = self.inlines(k.kids, mode, out)
        return out

    def _styled(self, out: str, k: Node, mark: str, mode: str) -> str:
        """Blanks go outside the delimiters, and an empty style leaves only its blanks."""
        inner = self.inlines(k.kids, mode, out + mark)[len(out) + len(mark) :]
        body = inner.rstrip(" ")
        tail = inner[len(body) :]
        lead = len(body) - len(body.lstrip(" "))
        body = body[lead:]
        return out + " " * lead + (mark + body + mark if body else "") + tail

    # -------------------------------------------------------------- blocks
    def write(self, first: str, rest: str, line: str) -> tuple[str, str]:
        self.lines.append((first + line).rstrip(" ") if not line else first + line)
        return rest, rest

    def blocks(self, kids: list[Node], first: str, rest: str, tight: bool = False, begun: bool = False) -> bool:
        """Write sibling blocks; ``first`` prefixes the next line, ``rest`` all others.  Gives whether any line came."""
        for k in kids:
            if begun and not tight:
                self.lines.append(rest.rstrip(" "))
            n = len(self.lines)
            self.block(k, first, rest)
            if len(self.lines) > n:
                first = rest
            begun = True
        return begun

    def block(self, k: Node, first: str, rest: str) -> None:
        t = k.tag
        if t in ("paragraph", "plain"):
            for i, line in enumerate(self.inlines(k.kids, "multiline").split("\n")):
                self.write(first if not i else rest, rest, line.strip(" "))
        elif t == "heading":
            ident, mark = (k.attrs or {}).get("id"), "#" * k.p["level"] + " "
            text = self.inlines(k.kids, "line", mark)[len(mark) :].strip(" ")  # behind the mark nothing begins a block
            self.write(first, rest, mark + _CLOSING.sub(r"\\\1", text) + (f" {{#{ident}}}" if ident else ""))
        elif t == "code_block":
            fence = "`" * max(3, _longest(k.text, "`") + 1)
            classes = (k.attrs or {}).get("classes") or [""]
            for i, line in enumerate([fence + classes[0], *k.text.rstrip("\n").split("\n"), fence]):
                self.write(first if not i else rest, rest, line)
        elif t == "raw_block":
            if k.p.get("format") in ("markdown", "html"):
                for i, line in enumerate(k.text.rstrip("\n").split("\n")):
                    self.write(first if not i else rest, rest, line)
            else:
                self.hits["raw-dropped"] += 1
        elif t == "thematic_break":
            self.write(first, rest, "---")
        elif t == "line_block":
            lines = "\\\n".join(self.inlines(x.kids, "line") for x in k.kids).split("\n")
            for i, line in enumerate(lines):
                self.write(first if not i else rest, rest, line)
        elif t == "table":
            self.table(k, first, rest)
        elif t == "definition_term":
            self.write(first, rest, f"**{self.inlines(k.kids, 'line')}**")
        elif t == "quote":
            self.blocks(k.kids, first + "> ", rest + "> ")
        elif t == "list":
            self.list(k, first, rest)
        else:
            if t == "container" and k.attrs:
                self.hits["container-attrs"] += 1
            elif t == "extension":
                self.hits["extension-fallback"] += 1
            elif t == "definition_list":
                self.hits["definition-list"] += 1
            self.blocks(k.kids, first, rest)

    def list(self, k: Node, first: str, rest: str) -> None:
        ordered, number = k.p.get("kind") == "ordered", k.p.get("start") or 0 if k.p.get("kind") == "ordered" else 1
        if ordered and k.p.get("start") is None:
            number = 1
        if ordered and k.p.get("style", "decimal") != "decimal":
            self.hits["number-style"] += 1
        tight = not any(item.kids and item.kids[0].tag == "paragraph" for item in k.kids)
        mark = "." if k.p.get("delimiter", "period") == "period" else ")"
        pending = ""
        for i, item in enumerate(k.kids):
            if i and not tight:
                self.lines.append(rest.rstrip(" "))
            bullet = f"{number}{mark} " if ordered else "- "
            number += 1
            n = len(self.lines)
            self.blocks(item.kids, first + pending + bullet, rest + " " * len(bullet), tight)
            if len(self.lines) > n:
                first, pending = rest, ""
            else:  # an item without lines leaves its marker to the next line
                pending += bullet

    # -------------------------------------------------------------- tables
    def cell(self, blocks: list[Node]) -> str:
        parts: list[str] = []

        def add(piece: str) -> None:
            if piece:
                parts.append((" " if parts and not parts[-1].endswith(" ") else "") + piece)

        def one_line(s: str) -> str:
            return _BREAKING.sub(" ", s)

        def walk(kids: list[Node]) -> None:
            for k in kids:
                if k.tag == "table":
                    add("(nested table)")
                    self.hits["nested-table"] += 1
                elif k.tag in ("paragraph", "plain", "line", "definition_term", "heading"):
                    add(one_line(self.inlines(k.kids, "cell")))
                elif k.tag == "code_block":
                    add("`" + one_line(k.text).replace("|", "\\|").strip(" ") + "`")
                elif k.tag == "raw_block":
                    if k.p.get("format") in ("markdown", "html"):
                        add(one_line(k.text).replace("|", "\\|"))
                    else:
                        self.hits["raw-dropped"] += 1
                else:
                    if k.tag == "container" and k.attrs:
                        self.hits["container-attrs"] += 1
                    elif k.tag == "extension":
                        self.hits["extension-fallback"] += 1
                    elif k.tag == "definition_list":
                        self.hits["definition-list"] += 1
                    elif k.tag == "list" and k.p.get("kind") == "ordered" and k.p.get("style", "decimal") != "decimal":
                        self.hits["number-style"] += 1
                    walk(k.kids)

        walk(blocks)
        return "".join(parts)

    def table(self, k: Node, first: str, rest: str) -> None:
        rows: list[list[str]] = []
        caption = None
        for section in k.kids:
            if section.tag == "caption":
                caption = section
                continue
            for row in section.kids:
                cells = []
                for c in row.kids:
                    span = c.p.get("col_span") or 1
                    if span > 1 or (c.p.get("row_span") or 1) > 1:
                        self.hits["cell-span"] += 1
                    cells += [self.cell(c.kids), *[""] * (span - 1)]
                    if flattens(c):
                        self.hits["cell-flattened"] += 1
                rows.append(cells)
        if caption is not None:
            self.hits["table-caption"] += 1
        if rows:
            alignments = list(k.p.get("alignments") or [])
            count = max(len(alignments), *map(len, rows))
            width = [min(MAX_PAD, max(3, *(len(r[j].encode()) if j < len(r) else 0 for r in rows))) for j in range(count)]

            def line(r: list[str]) -> str:
                return "|" + "".join(f" {c}{' ' * max(0, width[j] - len(c.encode()))} |" for j, c in enumerate([*r, *[""] * (count - len(r))]))

            rule = []
            for j, w in enumerate(width):
                a = alignments[j] if j < len(alignments) else "default"
                rule.append(" " + (":" if a in ("left", "center") else "-") + "-" * (w - 2) + (":" if a in ("right", "center") else "-") + " |")
            for i, text in enumerate([line(rows[0]), "|" + "".join(rule), *map(line, rows[1:])]):
                self.write(first if not i else rest, rest, text)
            if caption is not None:
                self.lines.append(rest.rstrip(" "))
            first = rest
        if caption is not None:
            self.write(first, rest, self.cell(caption.kids))

    # --------------------------------------------------------------- whole
    def render(self) -> str:
        self.blocks(self.doc.body, "", "")
        done = 0
        while done < len(self.notes):  # a note may refer to further ones
            forest = self.doc.notes[self.notes[done]] if self.notes[done] < len(self.doc.notes) else []
            marker = f"[^{done + 1}]: "
            if forest:
                if self.lines:
                    self.lines.append("")
                self.blocks(forest, marker, " " * len(marker))
            done += 1
        return "".join(line + "\n" for line in self.lines)


def render(doc: Document, urls: dict[int, str] | None = None) -> tuple[str, dict[str, int]]:
    """Markdown and how often each lowering rule was used.  urls: resource number -> published name."""
    w = Writer(doc)
    w.urls = urls or {}
    return w.render(), dict(w.hits)


def report_losses(doc: Document, hits: dict[str, int]) -> None:
    """The writer's losses among the document's reports.  Their price is in the plan, so they carry none of their own."""
    for rule, n in hits.items():
        doc.report(CODES[rule], "warning" if rule == "nested-table" else "note", count=n)
