"""reStructuredText: underlined headings, flat lists, literal blocks, directives as containers, and link targets."""

from __future__ import annotations

import re

from leafmill.functions.limits import DEFAULT, Limits
from leafmill.functions.tree import Builder, Document, Refused

_TARGET = re.compile(r"\.\.[ ]+_(`[^`]+`|[^:`]+):[ ]+(\S+)$")
_DIRECTIVE = re.compile(r"\.\.[ ]+([\w-]+)::[ \t]*(.*)$")
_BULLET = re.compile(r"[-*+][ ]+(\S.*)$")
_NUMBER = re.compile(r"(?:(\d{1,9})|#)([.)])[ ]+(\S.*)$")
_INLINE = re.compile(r"``(.+?)``|\*\*(\S(?:.*?\S)?)\*\*|(?<!\w)\*(\S(?:[^*]*?\S)?)\*(?!\w)|`([^`<]*?)[ ]*<([^`>]+)>`__?|`([^`]+)`_(?!_)|(?<![\w`])([A-Za-z][\w.-]*)_(?![\w_])|(https?://[^\s<>]*[^\s<>.,;:!?)])", re.S)
_ADORNMENT = re.compile(r"([!-/:-@\[-`{-~])\1*$")


def _key(s: str) -> str:
    return " ".join(s.strip("`").lower().split())


def read(content: bytes, name: str = "", limits: Limits = DEFAULT) -> Document:
    try:
        lines = [x.rstrip() for x in content.decode("utf-8").replace("\r\n", "\n").expandtabs(8).split("\n")]
    except UnicodeDecodeError as e:
        raise Refused("rst.invalid-utf8") from e
    targets: dict[str, str] = {}
    for line in lines:
        m = _TARGET.match(line)
        if m:
            targets.setdefault(_key(m.group(1)), m.group(2))
    out = Builder(limits)

    def inlines(text: str) -> None:
        at = 0
        for m in _INLINE.finditer(text):
            code, strong, emphasis, label, url, ref, word, bare = m.groups()
            if (ref is not None and _key(ref) not in targets) or (word is not None and _key(word) not in targets):
                continue
            plain(text[at : m.start()])
            if code is not None:
                out.inline("code", text=code.replace("\n", " "))
            elif strong is not None or emphasis is not None:
                out.begin("strong" if strong is not None else "emphasis")
                plain(strong if strong is not None else emphasis)
                out.end()
            else:
                shown = label if url is not None else ref or word or bare
                out.begin("link", url=url or bare or targets[_key(ref or word)], title="")
                plain(shown or url)
                out.end()
            at = m.end()
        plain(text[at:])

    def plain(text: str) -> None:
        for k, part in enumerate(text.split("\n")):
            if k:
                out.soft_break()
            out.text(re.sub(r"\\(.)", r"\1", part))

    levels: list[str] = []
    i, n = 0, len(lines)

    def indented(i: int) -> tuple[list[str], int]:
        body: list[str] = []
        while i < n and (not lines[i] or lines[i].startswith(" ")):
            body.append(lines[i])
            i += 1
        while body and not body[-1]:
            body.pop()
        while body and not body[0]:
            body.pop(0)
        margin = min((len(x) - len(x.lstrip(" ")) for x in body if x), default=0)
        return [x[margin:] for x in body], i

    def paragraph(text: list[str], tag: str = "paragraph") -> None:
        out.open(tag)
        inlines("\n".join(x.strip() for x in text))
        out.close()

    while i < n:
        line = lines[i]
        if not line:
            i += 1
            continue
        after = lines[i + 1] if i + 1 < n else ""
        m = _ADORNMENT.match(after)
        if m and not line.startswith(" ") and len(after) >= len(line) and not _ADORNMENT.match(line):
            if m.group(1) not in levels:
                levels.append(m.group(1))
            out.open("heading", level=min(levels.index(m.group(1)) + 1, 6))
            inlines(line.strip())
            out.close()
            i += 2
            continue
        if _ADORNMENT.match(line) and len(line) >= 4:
            out.leaf("thematic_break")
            i += 1
            continue
        if _TARGET.match(line):
            i += 1
            continue
        m = _DIRECTIVE.match(line)
        if m:
            kind, rest = m.groups()
            body, i = indented(i + 1)
            if kind in ("include", "raw", "literalinclude"):
                out.report("rst.include-refused", "warning", loss="dropped", context=kind)
                continue
            while body and re.match(r":[\w-]+:", body[0]):
                body.pop(0)
            if kind in ("code", "code-block", "sourcecode"):
                while body and not body[0]:
                    body.pop(0)
                out.leaf("code_block", text="".join(x + "\n" for x in body), attrs={"classes": [rest]} if rest else None)
                continue
            if kind == "image":
                out.open("paragraph")
                out.begin("image", url=rest, title="")
                out.end()
                out.close()
                continue
            out.open("container", attrs={"classes": [kind]})
            if rest:
                paragraph([rest])
            part: list[str] = []
            for x in [*body, ""]:
                if x:
                    part.append(x)
                elif part:
                    paragraph(part)
                    part = []
            out.close()
            continue
        if line.startswith(".. ") or line == "..":
            _, i = indented(i + 1)
            continue
        m = _BULLET.match(line) or _NUMBER.match(line)
        if m:
            ordered = m.re is _NUMBER
            out.open("list", kind="ordered" if ordered else "unordered", start=int(m.group(1) or 1) if ordered else 1, style="decimal", delimiter="paren" if ordered and m.group(2) == ")" else "period")
            while i < n:
                x = (_NUMBER if ordered else _BULLET).match(lines[i])
                if not x:
                    break
                text = [x.group(3 if ordered else 1)]
                i += 1
                while i < n and lines[i].startswith(" ") and lines[i].strip():
                    text.append(lines[i])
                    i += 1
                out.open("list_item")
                paragraph(text, "plain")
                out.close()
                while i < n and not lines[i] and i + 1 < n and (_NUMBER if ordered else _BULLET).match(lines[i + 1]):
                    i += 1
            out.close()
            continue
        if line.startswith(" "):
            body, i = indented(i)
            out.open("quote")
            part = []
            for x in [*body, ""]:
                if x:
                    part.append(x)
                elif part:
                    paragraph(part)
                    part = []
            out.close()
            continue
        text = []
        while i < n and lines[i] and not (i + 1 < n and text and _ADORNMENT.match(lines[i + 1]) and len(lines[i + 1]) >= len(lines[i])):
            text.append(lines[i])
            i += 1
        literal = text[-1].endswith("::")
        if literal:
            text[-1] = "" if text[-1] == "::" else text[-1][:-2].rstrip() if text[-1].endswith(" ::") else text[-1][:-1]
        if any(x.strip() for x in text):
            paragraph([x for x in text if x])
        if literal:
            body, i = indented(i)
            if body:
                out.leaf("code_block", text="".join(x + "\n" for x in body))
    return out.doc
