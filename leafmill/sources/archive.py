"""ZIP packages and their XML parts, guarded: entries are checked before anything is inflated, and inflating stops at a
budget."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
import zlib
from xml.parsers import expat

from leafmill.functions.limits import LimitExceeded, Limits
from leafmill.functions.tree import Refused


class Package:
    def __init__(self, content: bytes, limits: Limits, code: str):
        self.limits, self.code, self.left = limits, code, limits.max_archive_total_bytes
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError, EOFError, struct.error) as e:
            raise Refused(f"{code}.bad-archive" if code == "epub" else f"{code}.not-an-archive") from e
        infos = self.zip.infolist()
        if len(infos) > limits.max_archive_entries:
            raise LimitExceeded("max_archive_entries")
        self.entries: dict[str, zipfile.ZipInfo] = {}
        for i in infos:
            name = i.orig_filename
            if name.startswith("/") or "\\" in name or "\0" in name or ".." in name.split("/"):
                raise Refused(f"{code}.hostile-archive")
            if i.flag_bits & 1:
                raise Refused(f"{code}.encrypted")
            if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise Refused(f"{code}.unsupported-compression")
            self.entries.setdefault(name, i)

    def __contains__(self, name: str) -> bool:
        return name in self.entries

    def read(self, name: str) -> bytes | None:
        """A member's bytes; its budget is the least of the entry's cap, the ratio's and what is left in total."""
        info = self.entries.get(name)
        if info is None:
            return None
        raw = self.zip.fp
        raw.seek(info.header_offset)
        head = raw.read(30)
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            raise Refused(f"{self.code}.not-an-archive")
        raw.seek(info.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
        data = raw.read(info.compress_size)
        if len(data) < info.compress_size:
            raise Refused(f"{self.code}.not-an-archive")
        budget = min(self.limits.max_archive_entry_bytes, self.limits.max_archive_ratio * max(info.compress_size, 64), self.left)
        if info.compress_type == zipfile.ZIP_DEFLATED:
            try:
                data = zlib.decompressobj(-15).decompress(data, budget + 1)
            except zlib.error as e:
                raise Refused(f"{self.code}.not-an-archive") from e
        if len(data) > budget:
            raise LimitExceeded("max_archive_ratio")
        self.left -= len(data)
        return data

    def xml(self, name: str) -> Element | None:
        data = self.read(name)
        return None if data is None else parse_xml(data, self.limits, self.code)

    def relationships(self, part: str) -> dict[str, dict]:
        """id -> type, target (resolved against the part's folder), external."""
        folder, base = posixpath.split(part)
        root = self.xml(posixpath.join(folder, "_rels", f"{base}.rels"))
        out = {}
        for r in root.kids if root else ():
            if isinstance(r, Element) and r.tag == "Relationship":
                external = r.get("TargetMode") == "External"
                target = r.get("Target", "")
                out[r.get("Id", "")] = {"type": r.get("Type", "").rsplit("/", 1)[-1], "target": target if external else resolve(folder, target), "external": external}
        return out


def resolve(folder: str, target: str) -> str:
    return posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(folder, target)).lstrip("./") if target else ""


class Element:
    """An element by local name, with its namespace's URI; kids are elements and strings."""

    __slots__ = ("attrs", "kids", "ns", "tag")

    def __init__(self, tag: str, ns: str, attrs: dict[str, str]):
        self.tag, self.ns, self.attrs, self.kids = tag, ns, attrs, []

    def get(self, name: str, default: str | None = None) -> str | None:
        """An attribute by local name, whatever its namespace."""
        return self.attrs.get(name, default)

    def children(self, *tags: str) -> list[Element]:
        return [k for k in self.kids if isinstance(k, Element) and (not tags or k.tag in tags)]

    def child(self, *path: str) -> Element | None:
        at: Element | None = self
        for tag in path:
            at = next((k for k in at.kids if isinstance(k, Element) and k.tag == tag), None)
            if at is None:
                return None
        return at

    def walk(self):
        todo = [self]
        while todo:
            e = todo.pop()
            yield e
            todo += [k for k in reversed(e.kids) if isinstance(k, Element)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                out.append(e)
            else:
                todo += reversed(e.kids)
        return "".join(out)


def parse_xml(data: bytes, limits: Limits, code: str) -> Element:
    """A tree; a document type is refused, depth is bounded, and only the five XML entities exist."""
    root = Element("", "", {})
    stack = [root]
    p = expat.ParserCreate(namespace_separator="\n")
    p.buffer_text = True

    def start(name: str, attrs: dict[str, str]) -> None:
        ns, _, tag = name.rpartition("\n")
        if len(stack) > limits.max_depth:
            raise LimitExceeded("max_depth")
        e = Element(tag, ns, {k.rpartition("\n")[2]: v for k, v in attrs.items()})
        stack[-1].kids.append(e)
        stack.append(e)

    def refuse(*_: object) -> None:
        raise Refused(f"{code}.doctype-refused")

    p.StartElementHandler = start
    p.EndElementHandler = lambda _: stack.pop()
    p.CharacterDataHandler = lambda s: stack[-1].kids.append(s)
    p.StartDoctypeDeclHandler = refuse
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        raise Refused(f"{code}.malformed-xml") from e
    return next(k for k in root.kids if isinstance(k, Element))


def number(s: str | None, default: int = 0) -> int:
    """A whole number at the start of an attribute."""
    m = re.match(r"[ \t]*(-?\d+)", s or "")
    return int(m.group(1)) if m else default
