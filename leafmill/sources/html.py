"""HTML: a tolerant reader of tag soup.

Element classes follow what the elements mean; unknown ones are transparent.  Where real pages and simple stack
rules disagree, end tags are matched by their own name, ``<p>`` in a table cell starts a new paragraph of the
cell, and ``kbd``, ``tt`` and ``samp`` end at their own end tag.
"""

from __future__ import annotations

import re
from html.entities import html5

from leafmill.functions.limits import DEFAULT, Limits
from leafmill.functions.tree import SPACES, Builder, Document, Refused

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<tag>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAME = re.compile(r"[^\s/>=\"']+")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,8})|#([0-9]{1,8})|([A-Za-z][A-Za-z0-9]*));?")
_HEADINGS = {f"h{i}" for i in range(1, 7)}
_CONTAINERS = {"div", "section", "article", "aside", "figure", "main", "nav", "header", "footer"}
_STYLES = {"em": "emphasis", "i": "emphasis", "strong": "strong", "b": "strong", "s": "strikethrough", "del": "strikethrough", "strike": "strikethrough", "sup": "superscript", "sub": "subscript", "u": "underline", "ins": "underline"}
_CODES = {"code", "tt", "kbd", "samp"}
_SPANS = {"span", "small", "mark", "abbr", "cite", "q", "time", "label", "font", "var", "bdi", "bdo", "dfn"}
_VOID = {"meta", "link", "input", "wbr", "source", "col", "base", "area", "embed", "param", "track"}
_RAW = {"script", "style", "template", "head", "iframe", "svg", "noscript"}
_PASSED = {*_STYLES, *_SPANS, "a", "p", "summary", *_HEADINGS}


def decode(s: str) -> str:
    """Named entities with a semicolon, the old ones without, and numeric ones; unknown ones stay."""
    if "&" not in s:
        return s

    def one(m: re.Match) -> str:
        hexa, dec, name = m.groups()
        if name:
            if m.group().endswith(";"):
                return html5.get(name + ";") or _legacy(name + ";") or m.group()
            return _legacy(name) or m.group()
        n = int(hexa, 16) if hexa else int(dec)
        return "�" if n == 0 or n > 0x10FFFF or 0xD800 <= n < 0xE000 else chr(n)

    return _ENTITY.sub(one, s)


def _legacy(name: str) -> str | None:
    """The longest name that needs no semicolon at the start, and the rest of the text."""
    for n in range(min(len(name), 6), 1, -1):
        if name[:n] in html5:
            return html5[name[:n]] + name[n:]
    return None


def attributes(s: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(s):
        out.setdefault(name.lower(), decode(a or b or c))
    return out


def _span(v: str | None) -> int:
    return int(v) if v and v.isascii() and v.isdigit() and 1 <= int(v) <= 1000 else 1


class _Parser:
    def __init__(self, source: str, out: Builder, base: str = ""):
        self.s, self.out, self.base = source, out, base
        self.stack: list[tuple[str, str]] = []  # (element name, what stands for it: block, leaf, inline or none)
        self.details = 0
        self.pre: list[str] | None = None

    # ------------------------------------------------------------- stack
    def push(self, name: str, kind: str) -> None:
        if len(self.stack) >= self.out.limits.max_depth:
            raise Refused("html.too-deep", exit_class="limit")
        self.stack.append((name, kind))

    def pop(self) -> None:
        name, kind = self.stack.pop()
        if kind == "pre":
            self.out.leaf("code_block", text="".join(self.pre or []))
            self.pre = None
        elif kind == "leaf":
            if self.out.in_leaf:
                self.out.close()
        elif kind == "inline":
            self.out.end()
        elif kind in ("block", "cell", "details"):
            if kind == "cell" and self.out.in_leaf:
                self.out.close()
            node = self.out.current
            if kind == "details":
                self.details -= 1
                if node is not None and not node.kids:
                    self.out.open("paragraph")
                    self.out.close()
            self.out.close()

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.pop()

    def ensure(self) -> None:
        if not self.out.in_leaf:
            parent = self.out.current
            if parent is not None and parent.tag in ("table", "table_head", "table_body", "table_row", "list"):
                self.repair(parent.tag)
            self.out.open("plain" if self.stack and self.stack[-1][1] == "cell" and not self.out.current.kids else "paragraph")
            self.push("p", "leaf")

    def repair(self, tag: str) -> None:
        """Text where only structure may stand goes to a new item or cell."""
        if tag == "list":
            self.out.open("list_item")
            self.push("li", "block")
            return
        if tag == "table":
            self.out.open("table_body")
            self.push("tbody", "block")
        if tag in ("table", "table_head", "table_body"):
            self.out.open("table_row")
            self.push("tr", "block")
        self.out.open("table_cell", alignment="default", row_span=1, col_span=1)
        self.push("td", "cell")

    def close_leaf(self) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            name, kind = self.stack[i]
            if kind == "leaf":
                return self.pop_to(i)
            if kind not in ("inline", "none"):
                return None
        return None

    def close_implicit(self, names: set[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            name, _ = self.stack[i]
            if name in names:
                return self.pop_to(i)
            if name not in _PASSED and self.stack[i][1] != "none":
                return None
        return None

    # -------------------------------------------------------------- text
    def text(self, raw: str) -> None:
        if self.pre is not None:
            self.pre.append(decode(raw))
        elif not raw.strip(SPACES):
            if self.out.in_leaf:
                self.out.space()
        else:
            self.ensure()
            self.out.text(decode(raw))

    def url(self, u: str) -> str:
        if not self.base or not u or u.startswith(("#", "/")) or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", u):
            return u
        return self.base + u

    def run(self) -> None:
        s, at, n = self.s, 0, len(self.s)
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                self.text(s[at:])
                break
            if lt > at:
                self.text(s[at:lt])
            m = _MARKUP.match(s, lt)
            if m is None:
                self.ensure()
                self.out.text("<")
                at = lt + 1
                continue
            at = m.end()
            tag = m.group("tag")
            if tag is None:
                continue
            closing = tag.startswith("/")
            tag = tag[1:] if closing else tag
            empty = tag.endswith("/")
            tag = tag[:-1] if empty else tag
            name = _NAME.search(tag)
            if name is None or len(name.group()) > 24:
                continue
            element, rest = name.group().lower(), tag[name.end() :]
            at = self.end_tag(element, at) if closing else self.start_tag(element, rest, empty, at)
        self.pop_to(0)

    def end_tag(self, name: str, at: int) -> int:
        same = {name}
        if name in _HEADINGS:
            same = _HEADINGS
        elif name in ("td", "th"):
            same = {"td", "th"}
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in same:
                self.pop_to(i)
                break
        return at

    def start_tag(self, name: str, rest: str, empty: bool, at: int) -> int:
        out = self.out
        if self.pre is not None and name != "br":
            return at
        if name == "br":
            if self.pre is not None:
                self.pre.append("\n")
                return at
            self.ensure()
            out.hard_break()
        elif name == "hr":
            self.close_leaf()
            if not out.in_leaf:
                out.leaf("thematic_break")
        elif name == "img":
            a = attributes(rest)
            self.ensure()
            out.begin("image", url=self.url(a.get("src", "")), title="")
            out.text(a.get("alt", ""))
            out.end()
        elif name in _VOID:
            pass
        elif name in _RAW:
            if name in ("svg", "iframe"):
                out.report("html.skipped-embedded-content", "warning", consequence=f"{name} was left out", loss="dropped", context=name)
            if empty:
                return at
            end = re.compile(f"</{name}", re.I).search(self.s, at)
            close = self.s.find(">", end.end()) if end else -1
            return len(self.s) if close < 0 else close + 1
        elif empty:
            pass
        elif name in _HEADINGS:
            self.close_leaf()
            self.in_flow()
            out.open("heading", level=int(name[1]))
            self.push(name, "leaf")
        elif name in ("p", "summary"):
            self.close_leaf()
            self.in_flow()
            out.open("paragraph")
            self.push(name, "leaf")
        elif name == "blockquote":
            self.block(name, "quote")
        elif name == "pre":
            self.close_leaf()
            self.in_flow()
            self.pre = []
            self.push("pre", "pre")
        elif name in ("ul", "ol"):
            self.block(name, "list", kind="ordered" if name == "ol" else "unordered", start=1, style="decimal", delimiter="period")
        elif name == "li":
            self.close_leaf()
            self.close_implicit({"li"})
            if out.current is None or out.current.tag != "list":
                self.block("ul", "list", kind="unordered", start=1, style="decimal", delimiter="period")
            out.open("list_item")
            self.push("li", "block")
        elif name == "table":
            self.block(name, "table", alignments=["default"])
        elif name in ("thead", "tbody", "tfoot", "tr", "td", "th", "caption"):
            self.table_part(name, rest)
        elif name == "details":
            self.close_leaf()
            self.in_flow()
            if self.details:
                out.open("container")
                self.push(name, "block")
            else:
                self.details += 1
                out.open("extension", owner="org.leafmill.html", name="details", version=1)
                self.push(name, "details")
        elif name in _CONTAINERS:
            a = attributes(rest)
            classes = ([] if name == "div" else [name]) + ([a["class"]] if a.get("class") else [])
            attrs = {"id": a.get("id", ""), "classes": classes} if classes or a.get("id") else None
            self.block(name, "container", attrs=attrs)
        elif name in _CODES:
            self.ensure()
            end = re.compile(f"</{name}", re.I).search(self.s, at)
            stop = end.start() if end else len(self.s)
            out.inline("code", text=decode(re.sub(r"<[^>]*>", "", self.s[at:stop])))
            close = self.s.find(">", stop)
            return len(self.s) if close < 0 else close + 1
        elif name in _STYLES or name == "a" or name in _SPANS:
            self.ensure()
            a = attributes(rest)
            if name == "a":
                out.begin("link", url=self.url(a.get("href", "")), title=a.get("title", ""))
            elif name in _STYLES:
                out.begin(_STYLES[name])
            else:
                out.begin("span", attrs={"classes": [a["class"]]} if a.get("class") else None)
            self.push(name, "inline")
        else:
            self.push(name, "none")
        return at

    def in_flow(self) -> None:
        """Before a block: not inside table or list structure."""
        if self.out.in_leaf:
            self.close_leaf()
        parent = self.out.current
        if parent is not None and parent.tag in ("table", "table_head", "table_body", "table_row", "list"):
            self.repair(parent.tag)

    def block(self, name: str, tag: str, **p: object) -> None:
        self.close_leaf()
        self.in_flow()
        self.out.open(tag, **p)
        self.push(name, "block")

    def table_part(self, name: str, rest: str) -> None:
        out = self.out
        self.close_leaf()
        table = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == "table"), None)
        if table is None:
            return
        keep = {"thead": 0, "tbody": 0, "tfoot": 0, "caption": 0, "tr": 1, "td": 2, "th": 2}[name]
        levels = [i for i in range(table + 1, len(self.stack)) if self.stack[i][0] in ("thead", "tbody", "tr", "td", "caption")]
        self.pop_to(levels[keep] if keep < len(levels) else len(self.stack))
        if name == "caption":
            out.open("caption")
            self.push("caption", "block")
            return
        if name in ("thead", "tbody", "tfoot"):
            out.open("table_head" if name == "thead" else "table_body")
            self.push("thead" if name == "thead" else "tbody", "block")
            return
        if out.current.tag == "table":
            out.open("table_body")
            self.push("tbody", "block")
        if name == "tr" or out.current.tag != "table_row":
            out.open("table_row")
            self.push("tr", "block")
            if name == "tr":
                return
        a = attributes(rest)
        out.open("table_cell", alignment="default", row_span=_span(a.get("rowspan")), col_span=_span(a.get("colspan")))
        self.push("td", "cell")


def read_into(source: str, out: Builder, base: str = "") -> None:
    _Parser(source, out, base).run()


def read(content: bytes, name: str = "", limits: Limits = DEFAULT) -> Document:
    try:
        source = content.decode("utf-8")
    except UnicodeDecodeError as e:
        raise Refused("html.invalid-utf8") from e
    out = Builder(limits)
    read_into(source, out)
    return out.doc
