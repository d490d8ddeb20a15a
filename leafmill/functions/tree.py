"""The document tree: what readers build, filters rewrite and writers render; and its flat form for DataFrames.

A tree is flattened in preorder.  A node's descendants are the rows (node, node + subtree_len), so "is a descendant
of" is an interval test and "next sibling" is node + subtree_len.  forest 0 is the body, forest n > 0 is note n.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from .limits import DEFAULT, LimitExceeded, Limits

INLINE_LEAVES = frozenset({"plain", "paragraph", "heading", "line", "definition_term"})
TEXT_LEAVES = frozenset({"code_block", "raw_block"})
_WORDS = re.compile(r"[^ \t\r\n]+").findall
_BLANKS = frozenset({"space", "soft_break", "hard_break"})
SPACES = " \t\r\n"


class Node:
    """A block or an inline.  kids: child nodes; p: payload; attrs: {id, classes, pairs} or None."""

    __slots__ = ("attrs", "entity", "kids", "p", "tag", "text")

    def __init__(self, tag: str, kids: list[Node] | None = None, text: str | None = None, attrs: dict | None = None, **p: Any):
        self.tag, self.kids, self.text, self.attrs, self.p, self.entity = tag, [] if kids is None else kids, text, attrs, p, None

    def __repr__(self) -> str:
        return f"{self.tag}{self.p or ''}{'' if self.text is None else repr(self.text)}{self.kids or ''}"


class Text(Node):
    """A text inline: most nodes are such, and what they seldom have is made when it is asked for."""

    __slots__ = ()

    def __init__(self, text: str):
        self.tag = "text"
        self.text = text

    def __getattr__(self, name: str) -> Any:
        if name not in Node.__slots__:
            raise AttributeError(name)
        made = [] if name == "kids" else {} if name == "p" else None
        setattr(self, name, made)
        return made


#: All blanks that text() makes: a blank has nothing of its own.
SPACE = Node("space")


@dataclass
class Report:
    code: str
    severity: str = "note"
    consequence: str = ""
    loss: str = "none"
    directions: str = ""
    exit_class: str = "ok"
    count: int = 1
    contexts: list[str] = field(default_factory=list)


@dataclass
class Document:
    body: list[Node] = field(default_factory=list)
    notes: list[list[Node]] = field(default_factory=list)
    metadata: list[tuple[str, Any]] = field(default_factory=list)
    resources: list[dict] = field(default_factory=list)
    facets: list[dict] = field(default_factory=list)
    plugins: dict[str, tuple[int, Any]] = field(default_factory=dict)
    reports: list[Report] = field(default_factory=list)
    #: Most groups of reports, and most contexts of one; what is over is counted.
    most_groups: int = DEFAULT.max_report_groups
    most_samples: int = DEFAULT.max_report_samples
    #: Markdown and number of blocks of a document that was written as it was read, without a tree.
    written: tuple[str, int] | None = None

    def report(self, code: str, severity: str = "note", consequence: str = "", loss: str = "none", context: str | None = None, count: int = 1, **more: Any) -> None:
        """Reports alike in code, consequence and directions are one, with their counts summed."""
        for r in self.reports:
            if (r.code, r.consequence, r.directions) == (code, consequence, more.get("directions", "")):
                r.count += count
                r.severity = max(r.severity, severity, key=SEVERITIES.index)
                if context is not None and context not in r.contexts and len(r.contexts) < self.most_samples:
                    r.contexts.append(context)
                return
        if len(self.reports) >= self.most_groups and code != "core.reports-truncated":
            self.report("core.reports-truncated", "warning")
            return
        self.reports.append(Report(code, severity, consequence, loss, count=count, contexts=[] if context is None else [context], **more))


SEVERITIES = ["note", "warning", "failure"]


class Refused(Exception):
    """A reader's refusal: the document fails with a report, the task does not."""

    def __init__(self, code: str, consequence: str = "", exit_class: str = "input"):
        super().__init__(code)
        self.code, self.consequence, self.exit_class = code, consequence, exit_class


class Builder:
    """Writes a Document front to back.  Blocks nest by open()/close(); text goes to the open leaf."""

    def __init__(self, limits: Limits = DEFAULT):
        self.doc, self.limits, self.nodes = Document(most_groups=limits.max_report_groups, most_samples=limits.max_report_samples), limits, 0
        self.held_bytes = self.entities = 0
        self.blocks: list[tuple[Node | None, list[Node]]] = [(None, self.doc.body)]
        self.spans: list[Node] = []

    # blocks -------------------------------------------------------------
    def open(self, tag: str, attrs: dict | None = None, **p: Any) -> Node:
        node = self._node(Node(tag, attrs=attrs, **p))
        self.blocks[-1][1].append(node)
        if len(self.blocks) > self.limits.max_depth:
            raise LimitExceeded("max_depth")
        self.blocks.append((node, node.kids))
        if tag in INLINE_LEAVES:
            self.spans = [node]
        return node

    def close(self, tag: str | None = None) -> Node:
        node, _ = self.blocks.pop()
        assert node is not None and tag in (None, node.tag), (tag, node)
        if node.tag in INLINE_LEAVES:
            trim(node.kids)
            self.spans = []
        return node

    def leaf(self, tag: str, text: str | None = None, attrs: dict | None = None, **p: Any) -> Node:
        node = self._node(Node(tag, text=text, attrs=attrs, **p))
        self.blocks[-1][1].append(node)
        return node

    def note(self) -> int:
        """Open a note's forest; its number from 0.  Close with end_note()."""
        forest: list[Node] = []
        self.doc.notes.append(forest)
        self.blocks.append((None, forest))
        self._held = getattr(self, "_held", [])
        self._held.append(self.spans)
        self.spans = []
        return len(self.doc.notes) - 1

    def end_note(self) -> None:
        self.blocks.pop()
        self.spans = self._held.pop()

    @property
    def current(self) -> Node | None:
        return self.blocks[-1][0]

    @property
    def in_leaf(self) -> bool:
        return bool(self.spans)

    def _node(self, node: Node) -> Node:
        self.nodes += 1
        if self.nodes > self.limits.max_nodes:
            raise LimitExceeded("max_nodes")
        return node

    # inlines ------------------------------------------------------------
    def text(self, s: str) -> None:
        if not s:
            return
        kids = self.spans[-1].kids
        made, words = len(kids), _WORDS(s)
        if (s[0] in SPACES) and not (kids and kids[-1].tag in _BLANKS):
            kids.append(SPACE)
        if words:
            if kids and kids[-1].tag == "text":
                kids[-1].text += words.pop(0)
                if words:
                    kids.append(SPACE)
            new = [SPACE] * (2 * len(words) - 1 if words else 0)
            new[::2] = map(Text, words)
            kids += new
            if s[-1] in SPACES and kids[-1].tag != "space":
                kids.append(SPACE)
        self.nodes += len(kids) - made
        if self.nodes > self.limits.max_nodes:
            raise LimitExceeded("max_nodes")

    def space(self) -> None:
        kids = self.spans[-1].kids
        if not (kids and kids[-1].tag in ("space", "soft_break", "hard_break")):
            kids.append(self._node(Node("space")))

    def soft_break(self) -> None:
        kids = self.spans[-1].kids
        if not (kids and kids[-1].tag in ("space", "soft_break", "hard_break")):
            kids.append(self._node(Node("soft_break")))

    def hard_break(self) -> None:
        self.spans[-1].kids.append(self._node(Node("hard_break")))

    def begin(self, tag: str, attrs: dict | None = None, **p: Any) -> Node:
        node = self._node(Node(tag, attrs=attrs, **p))
        self.spans[-1].kids.append(node)
        self.spans.append(node)
        if len(self.spans) > self.limits.max_depth:
            raise LimitExceeded("max_depth")
        return node

    def end(self) -> Node:
        return self.spans.pop()

    def inline(self, tag: str, text: str | None = None, **p: Any) -> Node:
        node = self._node(Node(tag, text=text, **p))
        self.spans[-1].kids.append(node)
        return node

    # the rest -----------------------------------------------------------
    def meta(self, key: str, value: Any) -> None:
        self.doc.metadata.append((key, value))

    def resource(self, source: str, content: bytes | None, mime: str, alt: str = "") -> int:
        """The number of a resource; a source that is known keeps its first bytes."""
        for i, r in enumerate(self.doc.resources):
            if r["source"] == source:
                return i
        if len(self.doc.resources) >= self.limits.max_resources:
            raise LimitExceeded("max_resources")
        self.held_bytes += len(content or b"")
        if self.held_bytes > self.limits.max_resource_bytes:
            raise LimitExceeded("max_resource_bytes")
        self.doc.resources.append({"source": source, "content": content, "mime": mime, "kind": "external" if content is None else "embedded", "alt": alt})
        return len(self.doc.resources) - 1

    def facet(self, node: Node, kind: str, **values: Any) -> None:
        """A row of a facet table, bound to the node."""
        if len(self.doc.facets) >= self.limits.max_facet_rows:
            raise LimitExceeded("max_facet_rows")
        if node.entity is None:
            node.entity = self.entities
            self.entities += 1
        self.doc.facets.append({"entity": node.entity, "kind": kind, "values": values})

    def report(self, *a: Any, **k: Any) -> None:
        self.doc.report(*a, **k)


def trim(kids: list[Node]) -> None:
    """A leaf neither begins nor ends with blanks."""
    while kids and kids[-1].tag in ("space", "soft_break"):
        kids.pop()
    n = 0
    while n < len(kids) and kids[n].tag in ("space", "soft_break"):
        n += 1
    del kids[:n]


def plain_text(kids: list[Node]) -> str:
    out = []
    for k in kids:
        if k.tag in ("text", "code", "math"):
            out.append(k.text or "")
        elif k.tag in ("space", "soft_break", "hard_break"):
            out.append(" ")
        else:
            out.append(plain_text(k.kids))
    return "".join(out)


BLOCK_FIELDS = ("level", "kind", "start", "style", "delimiter", "format", "alignments", "row_head_columns", "head_rows", "alignment", "row_span", "col_span", "owner", "name", "version")
INLINE_FIELDS = ("url", "title", "resource", "kind", "format", "note", "id", "owner", "name", "version")


def _flatten(roots: list[Node], forest: int, blocks: list[dict], inlines: list[dict]) -> None:
    def add(node: Node, parent: int | None, depth: int) -> int:
        at = len(blocks)
        row = {"forest": forest, "node": at, "parent": parent, "depth": depth, "subtree_len": 1, "tag": node.tag, "text": node.text, "attrs": _attrs(node.attrs), "entity": node.entity}
        row.update({k: node.p.get(k) for k in BLOCK_FIELDS})
        blocks.append(row)
        if node.tag in INLINE_LEAVES:
            for kid in node.kids:
                _inline(kid, forest, at, None, 0, inlines)
        else:
            for kid in node.kids:
                row["subtree_len"] += add(kid, at, depth + 1)
        return row["subtree_len"]

    for root in roots:
        add(root, None, 0)


def _inline(node: Node, forest: int, block: int, parent: int | None, depth: int, out: list[dict]) -> int:
    at = len(out)
    row = {"forest": forest, "block": block, "node": at, "parent": parent, "depth": depth, "subtree_len": 1, "tag": node.tag, "text": node.text, "attrs": _attrs(node.attrs), "entity": node.entity}
    row.update({k: node.p.get(k) for k in INLINE_FIELDS})
    out.append(row)
    for kid in node.kids:
        row["subtree_len"] += _inline(kid, forest, block, at, depth + 1, out)
    return row["subtree_len"]


def _attrs(a: dict | None) -> dict | None:
    if not a:
        return None
    return {"id": a.get("id") or "", "classes": list(a.get("classes") or []), "pairs": [{"key": k, "value": v} for k, v in a.get("pairs") or []]}


def flatten(doc: Document) -> tuple[list[dict], list[dict]]:
    """Rows of blocks and inlines; node numbers run on through all forests of a document."""
    blocks: list[dict] = []
    inlines: list[dict] = []
    for forest, roots in enumerate([doc.body, *doc.notes]):
        _flatten(roots, forest, blocks, inlines)
    return blocks, inlines


def unflatten(blocks: list[dict], inlines: list[dict]) -> Document:
    """Rows, in any order, back to a tree.  Node numbers need only rise in preorder; a row whose parent is missing
    is a root of its forest."""
    doc = Document()
    by: dict[int, Node] = {}
    for r in sorted(blocks, key=lambda r: (r["forest"], r["node"])):
        node = Node(r["tag"], text=r["text"], attrs=_unattrs(r["attrs"]), **{k: r[k] for k in BLOCK_FIELDS if r.get(k) is not None})
        node.entity = r.get("entity")
        by[r["node"]] = node
        if r["parent"] is not None and r["parent"] in by:
            by[r["parent"]].kids.append(node)
        elif r["forest"] == 0:
            doc.body.append(node)
        else:
            while len(doc.notes) < r["forest"]:
                doc.notes.append([])
            doc.notes[r["forest"] - 1].append(node)
    own: dict[int, Node] = {}
    for r in sorted(inlines, key=lambda r: r["node"]):
        if r["block"] not in by:
            continue
        node = Node(r["tag"], text=r["text"], attrs=_unattrs(r["attrs"]), **{k: r[k] for k in INLINE_FIELDS if r.get(k) is not None})
        node.entity = r.get("entity")
        own[r["node"]] = node
        (own[r["parent"]].kids if r["parent"] in own else by[r["block"]].kids).append(node)
    return doc


def _unattrs(a: dict | None) -> dict | None:
    if a is None:
        return None
    return {"id": a["id"], "classes": list(a["classes"] or []), "pairs": [(p["key"], p["value"]) for p in a["pairs"] or []]}
