"""One document at a time, without Spark: the same readers, lowering and writer as the DataFrame engine."""

from __future__ import annotations

import enum
import hashlib
import json
import os
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path

from leafmill.functions.limits import DEFAULT, LimitExceeded, Limits
from leafmill.functions.markdown_writer import RULES, render, report_losses
from leafmill.functions.tree import Document, Report, flatten
from leafmill.operators.convert import parse_one, pixel_size
from leafmill.operators.manifest import SCHEMA, VERSION
from leafmill.operators.resources import ENDINGS
from leafmill.sources.detect import EXTENSIONS
from leafmill.sources.registry import READERS

__all__ = ["Conversion", "ConversionError", "Converter", "DestinationExistsError", "Format", "InputReadError", "LimitExceededError", "Limits", "Report", "Strictness", "UnknownFormatError", "convert", "formats"]
_MAGIC = {b"{\\rtf": "rtf", b"%PDF": "pdf"}


class Strictness(str, enum.Enum):
    OFF = "off"
    CONTENT = "content"
    STRUCTURE = "structure"
    EXACT = "exact"


class ConversionError(Exception):
    """A refused conversion; ``reports`` says why."""

    def __init__(self, reports: list[Report]):
        self.reports = reports
        last = next((r for r in reports if r.severity == "failure"), reports[-1])
        self.code, self.exit_class = last.code, last.exit_class
        super().__init__(f"{last.code}{': ' + last.consequence if last.consequence else ''}")


class LimitExceededError(ConversionError):
    pass


class UnknownFormatError(ConversionError):
    pass


class DestinationExistsError(ConversionError):
    pass


class InputReadError(Exception):
    pass


@dataclass(frozen=True)
class Format:
    name: str
    extensions: tuple[str, ...]
    can_read: bool
    can_write: bool


@dataclass
class Conversion:
    """What a conversion yields: artifact, resources by published name, manifest and reports."""

    artifact: str
    name: str
    source_format: str
    resources: dict[str, bytes]
    manifest: str
    reports: list[Report]
    losses: dict[str, int]
    document: Document = field(repr=False, default_factory=Document)

    def save(self, path: str | os.PathLike, overwrite: bool = False) -> list[Path]:
        """Artifact, resources and, last, the manifest; each by a rename, and nothing is replaced unless asked for."""
        path = Path(path)
        names = {path: self.artifact.encode(), **{path.parent / n: b for n, b in self.resources.items()}, path.with_name(path.name + ".leafmill.json"): self.manifest.encode()}
        if not overwrite:
            for p in names:
                if p.exists():
                    raise DestinationExistsError([Report("core.destination-exists", "failure", str(p), exit_class="conversion")])
        for p, data in names.items():
            p.parent.mkdir(parents=True, exist_ok=True)
            with tempfile.NamedTemporaryFile(dir=p.parent, delete=False) as f:
                f.write(data)
            os.replace(f.name, p)
        return list(names)


def sniff(content: bytes) -> str | None:
    """The same tests as the column expression, on bytes."""
    from leafmill.sources import detect

    if content[:4] == b"PK\x03\x04":
        return next((f for f, m in detect._ZIP if m in content), "zip")
    if content[:8] == detect._CFB_MAGIC:
        return next((f for f, s in detect._CFB if s.encode("utf-16-le") in content), "doc")
    return next((f for m, f in _MAGIC.items() if content.startswith(m)), None)


def resolve(name: str, content: bytes, declared: str | None, from_file: bool) -> tuple[str | None, str | None]:
    ext = name.replace("\\", "/").rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in name else None
    by_name = next((f for f, es in EXTENSIONS.items() if ext in es), None)
    if declared:
        return declared, None
    if from_file and by_name:
        return by_name, None
    seen = sniff(content)
    if seen == "zip":
        return by_name or "docx", None
    fmt = seen or by_name
    return fmt, "core.undetectable-input-format" if fmt is None else "core.extension-mismatch" if by_name and seen and seen != by_name else None


@dataclass(frozen=True)
class Converter:
    strict: Strictness | str = Strictness.OFF
    limits: Limits = DEFAULT
    preserve_facets: bool = False
    filters: tuple[Callable[[Document], Document], ...] = ()

    def formats(self) -> tuple[Format, ...]:
        return tuple(Format(f, tuple(EXTENSIONS[f]), True, f == "markdown") for f in READERS)

    def convert(self, source: str | os.PathLike | bytes, name: str | None = None, from_format: str | None = None, output: str | os.PathLike | None = None, overwrite: bool = False) -> Conversion:
        """source: a path (a str is always one) or bytes."""
        from_file = not isinstance(source, (bytes, bytearray, memoryview))
        if from_file:
            name = name or os.fspath(source)
            try:
                if os.path.getsize(source) > self.limits.max_input_bytes:
                    raise LimitExceededError([Report("core.input-too-large", "failure", "max_input_bytes", exit_class="limit")])
                content = Path(source).read_bytes()
            except OSError as e:
                raise InputReadError(str(e)) from e
        else:
            content, name = bytes(source), name or "document"
        if from_format is not None and from_format not in READERS:
            raise UnknownFormatError([Report("core.unknown-input-format", "failure", from_format, exit_class="usage")])
        fmt, note = resolve(name, content, from_format, from_file)
        status, doc = parse_one(content, name, fmt, note if fmt else None, READERS, self.limits)
        if status != "success":
            kind = LimitExceededError if any(r.exit_class == "limit" for r in doc.reports) else UnknownFormatError if fmt is None else ConversionError
            raise kind(doc.reports)
        for f in self.filters:
            doc = f(doc)
        stem = Path(name).stem or "document"
        names: dict[int, str] = {}
        for i, r in enumerate(doc.resources):
            if r["kind"] == "embedded":
                names[i] = f"{stem}_media/image-{len(names) + 1}.{ENDINGS.get(r['mime'], 'bin')}"
        text, losses = render(doc, names)
        if len(text.encode()) > self.limits.max_output_bytes:
            raise LimitExceededError([Report("core.output-too-large", "failure", "max_output_bytes", exit_class="limit")])
        price = [sum(RULES[k][i] * n for k, n in losses.items()) for i in range(3)]
        for r in doc.reports:
            i = {"dropped": 0, "structural": 1, "presentation": 2}.get(r.loss)
            if i is not None:
                price[i] += r.count
        report_losses(doc, losses)
        grade = ["off", "content", "structure", "exact"].index(Strictness(self.strict).value)
        if any(price[:grade]):
            raise ConversionError([*doc.reports, Report("core.strict-refused", "failure", Strictness(self.strict).value, exit_class="strict")])
        out = Conversion(text, f"{stem}.md", fmt, {names[i]: doc.resources[i]["content"] for i in names}, self._manifest(doc, text, content, fmt), doc.reports, losses, doc)
        if output is not None:
            out.save(output, overwrite)
        return out

    def _manifest(self, doc: Document, text: str, content: bytes, fmt: str) -> str:
        def digest(b: bytes) -> dict:
            return {"algorithm": "sha256", "hex": hashlib.sha256(b).hexdigest()}

        blocks, inlines = flatten(doc)
        kinds = sorted({f["kind"] for f in doc.facets})
        media = []
        for r in doc.resources:
            if r["kind"] == "embedded":
                w, h = pixel_size(r["content"])
                media.append({"digest": hashlib.sha256(r["content"]).hexdigest(), "mime": r["mime"], "pixel_height": h, "pixel_width": w, "source": r["source"]})
        facets = [{"kind": k, "count": sum(f["kind"] == k for f in doc.facets)} | ({"rows": [f["values"] | {"entity": f["entity"]} for f in doc.facets if f["kind"] == k]} if self.preserve_facets else {}) for k in kinds]
        body = {
            "artifact": digest(text.encode()), "ast": {"blocks": len(blocks), "inlines": len(inlines)}, "document_metadata": dict(reversed(doc.metadata)), "facets": facets, "media": media,
            "plugins": [{"data": d, "id": k, "version": v} for k, (v, d) in sorted(doc.plugins.items())], "reports": [{"code": r.code, "consequence": r.consequence, "contexts": r.contexts, "count": r.count, "loss": r.loss, "severity": r.severity} for r in doc.reports],
            "schema": SCHEMA, "schema_version": VERSION, "source": {"digest": digest(content), "format": fmt},
        }
        return json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def convert(source: str | os.PathLike | bytes, **options: object) -> Conversion:
    """convert(source, name=, from_format=, output=, overwrite=, strict=, limits=, preserve_facets=, filters=)."""
    own = {k: options.pop(k) for k in ("strict", "limits", "preserve_facets", "filters") if k in options}
    return replace(Converter(), **own).convert(source, **options)


def formats() -> tuple[Format, ...]:
    return Converter().formats()


__all__ += ["LimitExceeded", "resolve", "sniff"]
