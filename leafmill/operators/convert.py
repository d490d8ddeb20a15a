"""The engine: documents in, relations and artifacts out.

One row per document.  Detection is column expressions over name and bytes; parsing and rendering are one Python pass
each over Arrow batches, because a parser is a character-level state machine; all between them is SQL over the
nested rows, so nothing is shuffled.  A document that is refused is a row with status 'failed' and a report.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from leafmill import schema
from leafmill.functions.limits import DEFAULT, LimitExceeded, Limits
from leafmill.functions.markdown_writer import render, report_losses
from leafmill.functions.tree import Document, Refused, flatten, unflatten
from leafmill.operators.resources import ENDINGS
from leafmill.sources import registry
from leafmill.sources import text as text_source
from leafmill.sources.detect import EXTENSIONS, extension, resolve

Read = Callable[[bytes, str, Limits], Document]
#: (document, resource number -> published name) -> the artifact, and how often each lowering rule was used.
Write = Callable[[Document, dict[int, str]], tuple[str, dict[str, int]]]
#: Rows are whole documents, so batches are small: so many documents at most, and so many bytes or nodes of them unless one alone has more.
BATCH, BATCH_BYTES, BATCH_NODES = 64, 4 << 20, 1 << 16
#: Inlines without any in them.
WORDS = frozenset({"text", "space", "soft_break"})
#: What rendering adds.
ARTIFACT = "artifact string, losses map<string,bigint>"
#: Most documents of a scan that spread() gives to a task.
SHARE = 2000


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_parse_datatype_string(ddl))


def pixel_size(content: bytes | None) -> tuple[int | None, int | None]:
    """Of PNG, GIF and JPEG bytes."""
    if not content:
        return None, None
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack_from(">II", content, 16)
    if content[:4] == b"GIF8" and len(content) >= 10:
        return struct.unpack_from("<HH", content, 6)
    if content[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(content) and content[i] == 0xFF:
            m = content[i + 1]
            if 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack_from(">HH", content, i + 5)
                return w, h
            i += 2 + struct.unpack_from(">H", content, i + 2)[0]
    return None, None


def pieces(batch: pa.RecordBatch, weights: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most BATCH rows, and of a weight of at most ``most`` unless one row alone has more."""
    begin, held = 0, 0
    for i, w in enumerate(weights.to_pylist()):
        if i > begin and (i - begin == BATCH or held + (w or 0) > most):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += w or 0
    if batch.num_rows > begin:
        yield batch.slice(begin)


def rows_of(doc: Document) -> dict:
    blocks, inlines = flatten(doc)
    resources = []
    for i, r in enumerate(doc.resources):
        w, h = pixel_size(r["content"])
        resources.append({"idx": i, "source": r["source"], "mime": r["mime"], "kind": r["kind"], "content": r["content"], "digest": hashlib.sha256(r["content"]).hexdigest() if r["content"] is not None else None, "pixel_width": w, "pixel_height": h, "alt": r["alt"]})
    return {
        "blocks": blocks,
        "inlines": inlines,
        "metadata": [{"ordinal": i, "key": k, "value_type": "string" if isinstance(v, str) else "json", "value": v if isinstance(v, str) else json.dumps(v, sort_keys=True)} for i, (k, v) in enumerate(doc.metadata)],
        "resources": resources,
        "facets": [{"entity": f["entity"], "kind": f["kind"], "ordinal": i, "fields": json.dumps(f["values"], sort_keys=True, separators=(",", ":"))} for i, f in enumerate(doc.facets)],
        "plugins": [{"id": k, "version": v, "data": json.dumps(d, sort_keys=True, separators=(",", ":"))} for k, (v, d) in sorted(doc.plugins.items())],
        "reports": report_rows(doc),
    }


def names_of(doc: Document, stem: str) -> dict[int, str]:
    """Published names of embedded resources by their number, as published_names() gives them for rows."""
    own = [i for i, r in enumerate(doc.resources) if r["kind"] == "embedded"]
    return {i: f"{stem}_media/image-{k}.{ENDINGS.get(doc.resources[i]['mime'], 'bin')}" for k, i in enumerate(own, 1)}


def report_rows(doc: Document) -> list[dict]:
    return [{"seq": i, "code": r.code, "severity": r.severity, "consequence": r.consequence, "loss": r.loss, "directions": r.directions, "exit_class": r.exit_class, "count": r.count, "contexts": r.contexts} for i, r in enumerate(doc.reports)]


def rendered(doc: Document, names: dict[int, str], reports: list[dict], write: Write, most: int) -> dict:
    """status, artifact, losses and reports of a document that was read; reports: the rows of what its reader said."""
    text, hits = write(doc, names)
    own, status = Document(), "success"
    report_losses(own, hits)
    if len(text.encode()) > most:
        own.report("core.output-too-large", "failure", exit_class="limit", context="max_output_bytes")
        text, status = None, "failed"
    return {"status": status, "artifact": text, "losses": list(hits.items()), "reports": reports + [x | {"seq": len(reports) + x["seq"]} for x in report_rows(own)]}


def left_out(docs: DataFrame, content: Column) -> Column:
    """The length of a document that comes without its bytes."""
    return (F.when(content.isNull(), F.col("length").cast("long")) if "length" in docs.columns else F.lit(None).cast("long")).alias("__length")


def parse_one(content: bytes | None, name: str | None, fmt: str | None, note: str | None, readers: dict[str, Read], limits: Limits, length: int | None = None) -> tuple[str, Document]:
    """length: of a file whose bytes were left out, as it is over the limit."""
    doc = Document()
    if content is None and length:
        doc.report("core.input-too-large", "failure", exit_class="limit", context="max_input_bytes")
        return "failed", doc
    if fmt is None or fmt not in readers:
        doc.report("core.undetectable-input-format" if fmt is None else "core.unknown-input-format", "failure", exit_class="input", context=name or fmt)
        return "failed", doc
    content = content or b""
    try:
        if len(content) > limits.max_input_bytes:
            raise LimitExceeded("max_input_bytes")
        doc = readers[fmt](content, name or "", limits)
        status = "success"
    except Refused as e:
        doc.report(e.code, "failure", e.consequence, exit_class=e.exit_class)
        status = "failed"
    except LimitExceeded as e:
        doc.report({"max_input_bytes": "core.input-too-large", "max_depth": "core.depth-limit-exceeded"}.get(e.name, "core.limit-exceeded"), "failure", exit_class="limit", context=e.name)
        status = "failed"
    except (ValueError, KeyError, IndexError, AssertionError, RecursionError, struct.error, OverflowError, AttributeError, TypeError, NotImplementedError, EOFError, OSError) as e:
        doc = Document()
        doc.report("core.malformed-input", "failure", type(e).__name__, exit_class="internal")
        status = "failed"
    if note:
        doc.report(note, "note", context=name)
    return status, doc


@dataclass
class Engine:
    """A set of readers and writers, and limits.  readers: format -> function(bytes, name, limits); writers: format -> function(document,
    names of resources); extensions: of formats that are not built in, none of which may be told in two ways."""

    readers: dict[str, Read] = field(default_factory=lambda: dict(registry.READERS))
    limits: Limits = DEFAULT
    writers: dict[str, Write] = field(default_factory=lambda: {"markdown": render})
    extensions: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for f, way in [*self.readers.items(), *self.writers.items()]:
            if not f.isidentifier() or not f.islower():
                raise ValueError(f"a format's name is a lower-case word: {f!r}")
            if not callable(way):
                raise TypeError(f"{f} needs a function")
        seen: dict[str, str] = {}
        for f, endings in self.formats().items():
            for e in endings:
                if not re.fullmatch(r"[a-z0-9]+", e) or seen.setdefault(e, f) != f:
                    raise ValueError(f"an extension is small letters and digits and belongs to one format: {e!r} of {f}")

    def formats(self) -> dict[str, list[str]]:
        return {f: self.extensions.get(f, EXTENSIONS.get(f, [f])) for f in {**self.readers, **self.writers}}

    def with_reader(self, name: str, read: Read, *extensions: str) -> Engine:
        return replace(self, readers={**self.readers, name: read}, extensions={**self.extensions, name: list(extensions) or [name]} if name not in EXTENSIONS else self.extensions)

    def with_writer(self, name: str, write: Write, *extensions: str) -> Engine:
        return replace(self, writers={**self.writers, name: write}, extensions={**self.extensions, name: list(extensions) or [name]} if name not in EXTENSIONS else self.extensions)

    def writer(self, to: str) -> Write:
        if to not in self.writers:
            raise ValueError(f"no writer of {to!r}; there are {', '.join(self.writers)}")
        return self.writers[to]

    def resolved(self, name: Column, content: Column, declared: Column | None, from_file: bool = False) -> tuple[Column, Column]:
        """resolve() for the built-in formats, and by extension for others where that finds none."""
        fmt, note = resolve(name, content, declared, from_file)
        own = F.when(F.lit(False), F.lit(""))
        for f, endings in self.extensions.items():
            own = own.when(extension(name).isin(*endings), F.lit(f))
        return F.coalesce(fmt, own), F.when(fmt.isNotNull() | own.isNull(), note)

    def parse(self, docs: DataFrame, name: Column | str = "name", content: Column | str = "content", declared: Column | None = None, from_file: bool = False, keep: tuple[str, ...] = ("doc_id",), to: str | None = None, media_stem: Column | None = None) -> DataFrame:
        """docs -> keep columns, name, status, format, blocks, inlines, metadata, resources, facets, plugins, reports.

        to: render in the same pass, with what render() adds after this one: trees then neither go to a second Python worker nor are
        put together again there."""
        name = F.col(name) if isinstance(name, str) else name
        content = (F.col(content) if isinstance(content, str) else content).cast("binary")
        fmt, note = self.resolved(name, content, declared, from_file)
        stem = F.lit("document") if media_stem is None else media_stem
        base = docs.select(*keep, name.alias("name"), content.alias("__content"), fmt.alias("__format"), note.alias("__note"), left_out(docs, content), stem.alias("__stem"))
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.select(*keep, "name").schema.fields) + ", " + schema.PARSED + (f", {ARTIFACT}" if to else "")
        out, readers, limits, kept, write = arrow_schema(ddl), self.readers, self.limits, [*keep, "name"], self.writer(to) if to else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces(whole, pc.binary_length(whole.column("__content")), BATCH_BYTES):
                    rows = []
                    for r in batch.select(["__content", "name", "__format", "__note", "__length", "__stem"]).to_pylist():
                        status, doc = parse_one(r["__content"], r["name"], r["__format"], r["__note"], readers, limits, r["__length"])
                        row = {"status": status, "format": r["__format"], **rows_of(doc)}
                        if write and status == "success":
                            row |= rendered(doc, names_of(doc, r["__stem"]), row["reports"], write, limits.max_output_bytes)
                        rows.append(row)
                        del doc, row  # before the next one is read
                    made = pa.RecordBatch.from_pylist(rows, schema=pa.schema([f for f in out if f.name not in kept]))
                    yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made.columns, names=kept + made.schema.names)

        parsed = base.mapInArrow(run, ddl)
        return parsed.withColumn("sha256", F.sha2(F.col("artifact").cast("binary"), 256)) if to else parsed

    def render(self, parsed: DataFrame, media_stem: Column | None = None, to: str = "markdown") -> DataFrame:
        """Adds artifact (null where the status is not success), sha256, and the uses of each lowering rule.  An artifact over its limit
        is a refusal."""
        from leafmill.operators.resources import published_names

        stem = F.lit("document") if media_stem is None else media_stem
        base = parsed.withColumn("__names", published_names("resources", stem))
        cols, write, most = parsed.columns, self.writer(to), self.limits.max_output_bytes
        added = StructType([*parsed.schema.fields, *_parse_datatype_string(ARTIFACT).fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces(whole, pc.add(pc.list_value_length(whole.column("blocks")), pc.list_value_length(whole.column("inlines"))), BATCH_NODES):
                    text, losses, reports, status = [], [], [], []
                    for r in batch.select(["status", "blocks", "inlines", "reports", "__names"]).to_pylist():
                        row = {"status": r["status"], "reports": r["reports"], "artifact": None, "losses": None}
                        if r["status"] == "success":
                            names = {x["idx"]: x["name"] for x in r["__names"] or []}
                            row |= rendered(unflatten(r["blocks"], r["inlines"]), names, r["reports"], write, most)
                        text.append(row["artifact"])
                        losses.append(row["losses"])
                        reports.append(row["reports"])
                        status.append(row["status"])
                    told = pa.array(reports, batch.column("reports").type)
                    yield pa.RecordBatch.from_arrays([told if c == "reports" else pa.array(status, pa.string()) if c == "status" else batch.column(c) for c in cols] + [pa.array(text, pa.string()), pa.array(losses, pa.map_(pa.string(), pa.int64()))], names=[*cols, "artifact", "losses"])

        return base.mapInArrow(run, added).withColumn("sha256", F.sha2(F.col("artifact").cast("binary"), 256))

    def convert(self, docs: DataFrame, name: Column | str = "name", content: Column | str = "content", declared: Column | None = None, strict: str = "off", keep: tuple[str, ...] = ("doc_id",), filters: list[Callable[[DataFrame], DataFrame]] | None = None, media_stem: Column | None = None, to: str = "markdown") -> DataFrame:
        """keep columns, name, format, status, markdown (or what the writer ``to`` gives), n_blocks, n_headings, n_links, losses, reports.
        Without filters the tree never leaves Python: one pass parses, prices and renders.  media_stem: begins the names under
        which media are published, as for render()."""
        from leafmill.plans.lowering import graded

        if filters:
            parsed = self.parse(docs, name, content, declared, keep=keep)
            for f in filters:
                parsed = parsed.transform(f)
            out = self.render(parsed, media_stem, to)
            out = out.withColumns({"markdown": F.col("artifact"), "n_blocks": F.size("blocks"), "n_headings": F.expr("size(filter(blocks, b -> b.tag = 'heading'))"), "n_links": F.expr("size(filter(inlines, i -> i.tag = 'link'))")})
            return graded(out, strict).select(*keep, "name", "format", "status", "markdown", "n_blocks", "n_headings", "n_links", "losses", "reports")
        name = F.col(name) if isinstance(name, str) else name
        content = (F.col(content) if isinstance(content, str) else content).cast("binary")
        fmt, note = self.resolved(name, content, declared)
        stem = F.lit("document") if media_stem is None else media_stem
        base = docs.select(*keep, name.alias("name"), content.alias("__content"), fmt.alias("format"), note.alias("__note"), left_out(docs, content), stem.alias("__stem"))
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.select(*keep, "name", "format").schema.fields)
        more = f"status string, markdown string, n_blocks int, n_headings int, n_links int, losses map<string,bigint>, reports array<{schema.REPORT}>"
        types = arrow_schema(more)
        readers, limits, kept, write = self.readers, self.limits, [*keep, "name", "format"], self.writer(to)
        if write is render and readers.get("text") is text_source.read:
            readers = readers | {"text": text_source.written}

        def count(doc: Document) -> tuple[int, int, int]:
            blocks = heads = links = 0
            todo = [iter(doc.body), *map(iter, doc.notes)]  # a large table makes its rows as they are asked for
            from leafmill.functions.tree import INLINE_LEAVES

            while todo:
                node = next(todo[-1], None)
                if node is None:
                    todo.pop()
                    continue
                blocks += 1
                if node.tag in INLINE_LEAVES:
                    heads += node.tag == "heading"
                    inner = [x for x in node.kids if x.tag not in WORDS]
                    while inner:
                        x = inner.pop()
                        links += x.tag == "link"
                        inner += [y for y in x.kids if y.tag not in WORDS]
                else:
                    todo.append(iter(node.kids))
            return blocks, heads, links

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces(whole, pc.binary_length(whole.column("__content")), BATCH_BYTES):
                    rows = []
                    for r in batch.select(["__content", "name", "format", "__note", "__length", "__stem"]).to_pylist():
                        status, doc = parse_one(r["__content"], r["name"], r["format"], r["__note"], readers, limits, r["__length"])
                        if doc.written:
                            text, hits = doc.written[0], {}
                        else:
                            text, hits = write(doc, names_of(doc, r["__stem"])) if status == "success" else (None, {})
                        report_losses(doc, hits)
                        if text is not None and len(text.encode()) > limits.max_output_bytes:
                            doc.report("core.output-too-large", "failure", exit_class="limit", context="max_output_bytes")
                            status, text = "failed", None
                        n = (doc.written[1], 0, 0) if doc.written else count(doc)
                        rows.append({"status": status, "markdown": text, "n_blocks": n[0], "n_headings": n[1], "n_links": n[2], "losses": list(hits.items()), "reports": report_rows(doc)})
                        del doc  # before the next one is read
                    made = pa.RecordBatch.from_pylist(rows, schema=types)
                    yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made.columns, names=kept + made.schema.names)

        out = base.mapInArrow(run, f"{ddl}, {more}")
        return graded(out, strict).select(*keep, "name", "format", "status", "markdown", "n_blocks", "n_headings", "n_links", "losses", "reports")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan dealt out evenly to tasks of at most SHARE documents, so that tasks grow in number with the input, not in size.  Parsing a
    document takes far longer than moving it, and counting a scan reads little more than its footers."""
    tasks = max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // SHARE))
    return scan.repartition(tasks) if scan.rdd.getNumPartitions() < tasks else scan


def files(spark, path: str, limits: Limits = DEFAULT) -> DataFrame:
    """Files as (doc_id, name, length, content); those over the limit without their bytes, which are then never read, so that
    conversion refuses them with a report."""
    return listed(lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), limits)


all_files = files


def listed(scan: Callable[[], DataFrame], limits: Limits) -> DataFrame:
    named = [F.xxhash64("path").alias("doc_id"), F.col("path").alias("name"), "length"]
    small = scan().where(F.col("length") <= limits.max_input_bytes).select(*named, "content")
    large = scan().where(F.col("length") > limits.max_input_bytes).select(*named)
    return small.unionByName(large.withColumn("content", F.lit(None).cast("binary")))
