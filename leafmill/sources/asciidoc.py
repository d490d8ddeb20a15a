"""AsciiDoc: headings, lists, delimited blocks, admonitions, constrained styles and links."""

from __future__ import annotations

import re

from leafmill.functions.limits import DEFAULT, Limits
from leafmill.functions.runs import Lists
from leafmill.functions.tree import Builder, Document, Refused

_HEADING = re.compile(r"(={1,6})[ \t]+(\S.*)$")
_ATTRIBUTE = re.compile(r":([A-Za-z0-9_][\w-]*):(?:[ \t]+(.*))?$")
_STYLE = re.compile(r"\[([^\]]*)\]$")
_ITEM = re.compile(r"[ \t]*(\*{1,8}|\.{1,8}|-)[ \t]+(\S.*)$")
_ADMONITION = re.compile(r"(NOTE|TIP|IMPORTANT|WARNING|CAUTION):[ \t]+(.*)$")
_INLINE = re.compile(r"`([^`\n]+)`|(?<!\w)\*(\S(?:[^*\n]*\S)?)\*(?!\w)|(?<!\w)_(\S(?:[^_\n]*\S)?)_(?!\w)|(?:link:)?((?:https?|ftp|mailto):[^\s\[\]]+|(?<=link:)[^\s\[\]]+)\[([^\]]*)\]|((?:https?|ftp)://[^\s\[\]<>]*[^\s\[\]<>.,;:!?)])")
_CONTAINERS = {"====": "example", "****": "sidebar"}


def inlines(out: Builder, text: str) -> None:
    at = 0
    for m in _INLINE.finditer(text):
        out.text(text[at : m.start()])
        code, strong, emphasis, url, label, bare = m.groups()
        if code is not None:
            out.inline("code", text=code)
        elif strong is not None or emphasis is not None:
            out.begin("strong" if strong is not None else "emphasis")
            inlines(out, strong if strong is not None else emphasis)
            out.end()
        else:
            out.begin("link", url=url or bare, title="")
            out.text(label or url or bare)
            out.end()
        at = m.end()
    out.text(text[at:])


def read(content: bytes, name: str = "", limits: Limits = DEFAULT) -> Document:
    try:
        lines = content.decode("utf-8").replace("\r\n", "\n").split("\n")
    except UnicodeDecodeError as e:
        raise Refused("asciidoc.invalid-utf8") from e
    out = Builder(limits)
    lists = Lists(out, 8)
    style: str | None = None
    container: str | None = None
    i = 0

    def end_text() -> None:
        if out.in_leaf:
            out.close()

    while i < len(lines):
        line = lines[i].rstrip(" \t\r")
        i += 1
        if not line:
            end_text()
            continue
        mark = line if len(line) >= 4 and len(set(line)) == 1 and line[0] in "-.=*_" else None
        if mark and (mark[0] in "-." or mark[:4] in _CONTAINERS or mark[0] == "_"):
            end_text()
            lists.end()
            if mark[0] in "-.":
                body = []
                while i < len(lines) and lines[i].rstrip(" \t\r") != mark:
                    body.append(lines[i].rstrip("\r"))
                    i += 1
                i += 1
                language = (style or "").split(",")[1].strip() if style and style.startswith("source,") else ""
                out.leaf("code_block", text="".join(x + "\n" for x in body), attrs={"classes": [language]} if language else None)
            elif container == mark:
                out.close()
                container = None
            elif container is None:
                container = mark
                if mark[0] == "_":
                    out.open("quote")
                else:
                    out.open("container", attrs={"classes": [_CONTAINERS[mark[:4]]]})
            style = None
            continue
        if line == "'''":
            end_text()
            lists.end()
            out.leaf("thematic_break")
            continue
        m = _ATTRIBUTE.match(line)
        if m and not out.in_leaf:
            out.meta(m.group(1), m.group(2) or "")
            continue
        if line.startswith("include::"):
            end_text()
            if not any(r.code == "asciidoc.include-refused" for r in out.doc.reports):
                out.report("asciidoc.include-refused", "warning", loss="dropped")
            continue
        if line.startswith("//") and not line.startswith("///"):
            continue
        m = _STYLE.match(line)
        if m and not out.in_leaf:
            style = m.group(1)
            continue
        m = _HEADING.match(line)
        if m:
            end_text()
            lists.end()
            out.open("heading", level=len(m.group(1)))
            out.text(m.group(2))
            out.close()
            if len(m.group(1)) == 1 and not any(k == "title" for k, _ in out.doc.metadata):
                pass
            continue
        m = _ITEM.match(line)
        if m and m.group(1) != "-" * 4:
            end_text()
            ordered = m.group(1)[0] == "."
            lists.item(len(m.group(1)) - 1 if m.group(1)[0] != "-" else 0, m.group(1)[0], ordered)
            out.open("plain")
            inlines(out, m.group(2))
            style = None
            continue
        m = _ADMONITION.match(line)
        if m and not out.in_leaf:
            lists.end()
            words = [m.group(2)]
            while i < len(lines) and lines[i].strip():
                words.append(lines[i].strip())
                i += 1
            out.open("container", attrs={"classes": [m.group(1).lower()]})
            out.open("paragraph")
            inlines(out, "\n".join(words))
            out.close()
            out.close()
            continue
        if out.in_leaf:
            out.soft_break()
        else:
            lists.end()
            out.open("paragraph")
        inlines(out, line.strip())
        style = None
    end_text()
    lists.end()
    return out.doc
