"""PPT: text atoms in stream order."""

from __future__ import annotations

import struct

from leafmill.functions.limits import DEFAULT, Limits
from leafmill.functions.tree import Builder, Document, Refused
from leafmill.sources.compound import Compound

_HEADER, _CHARS, _BYTES, _CRYPT = 3999, 4000, 4008, 12052


def atoms(stream: bytes):
    """(type, data) of all atoms; containers are walked into."""
    at = 0
    while at + 8 <= len(stream):
        version, kind, size = struct.unpack_from("<HHI", stream, at)
        at += 8
        if version & 15 == 15:
            continue
        yield kind, stream[at : at + size]
        at += size


def read(content: bytes, name: str = "", limits: Limits = DEFAULT) -> Document:
    box, out = Compound(content, "ppt"), Builder(limits)
    stream = box.stream("PowerPoint Document")
    if stream is None:
        raise Refused("ppt.missing-document-stream")
    out.report("ppt.presentation-projection", "note", loss="presentation")
    kind, slide, notes = 4, 0, False
    for t, data in atoms(stream):
        if t == _CRYPT:
            raise Refused("ppt.encryption-refused")
        if t == _HEADER and len(data) >= 4:
            kind, = struct.unpack_from("<I", data)
            slide += kind in (0, 6)
        elif t in (_CHARS, _BYTES):
            text = data.decode("utf-16-le" if t == _CHARS else "cp1252", "replace")
            if (kind == 2) != notes:
                if notes:
                    out.close()
                else:
                    out.open("container", attrs={"classes": ["notes"]})
                notes = not notes
            for line in text.split("\r"):
                if not line.strip(" \x0b\x00"):
                    continue
                title = kind in (0, 6)
                node = out.open("heading", level=2) if title else out.open("paragraph")
                if title:
                    out.facet(node, "provenance", plugin="ppt", member=f"slide-{slide}", byte_start=0, byte_len=0, confidence="exact")
                for k, part in enumerate(line.replace("\x00", "").split("\x0b")):
                    if k:
                        out.hard_break()
                    out.text(part)
                out.close()
    if notes:
        out.close()
    return out.doc
