"""EPUB: the spine's chapters, one after the other."""

from __future__ import annotations

import posixpath
from urllib.parse import unquote

from leafmill.functions.limits import DEFAULT, Limits
from leafmill.functions.tree import Builder, Document, Refused
from leafmill.sources import html
from leafmill.sources.archive import Package, resolve


def read(content: bytes, name: str = "", limits: Limits = DEFAULT) -> Document:
    pkg, out = Package(content, limits, "epub"), Builder(limits)
    if "META-INF/encryption.xml" in pkg:
        raise Refused("epub.drm-refused")
    container = pkg.xml("META-INF/container.xml")
    if container is None:
        raise Refused("epub.missing-container")
    path = next((e.get("full-path") for e in container.walk() if e.tag == "rootfile" and e.get("full-path")), None)
    opf = pkg.xml(path) if path else None
    if opf is None:
        raise Refused("epub.missing-package")
    folder = posixpath.dirname(path)
    meta = opf.child("metadata")
    for key, tag in (("title", "title"), ("author", "creator"), ("language", "language"), ("date", "date")):
        e = meta.child(tag) if meta else None
        if e is not None and e.text().strip():
            out.meta(key, " ".join(e.text().split()))
    items = {i.get("id", ""): i for i in (opf.child("manifest").children("item") if opf.child("manifest") else ())}
    for ref in opf.child("spine").children("itemref") if opf.child("spine") else ():
        item = items.get(ref.get("idref", ""))
        if item is None:
            out.report("epub.skipped-spine-item", "warning", loss="dropped", context=ref.get("idref", ""))
            continue
        member = resolve(folder, unquote(item.get("href", "")))
        data = pkg.read(member)
        if data is None:
            out.report("epub.missing-chapter", "warning", loss="dropped", context=member)
            continue
        try:
            source = data.decode("utf-8-sig")
        except UnicodeDecodeError:
            out.report("epub.skipped-spine-item", "warning", loss="dropped", context=member)
            continue
        before = len(out.doc.body)
        here = posixpath.dirname(member)
        html.read_into(source, out, here + "/" if here else "")
        if len(out.doc.body) > before:
            out.facet(out.doc.body[before], "provenance", plugin="epub", member=member, byte_start=0, byte_len=len(data), confidence="projected")
    return out.doc
