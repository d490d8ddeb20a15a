"""Conversions saved by the tasks that made them: artifact, media and, last, the manifest, each by a rename.

A task that runs again after its executor was lost finds what it wrote before: a file with the same bytes counts as its own, so
only a file with other bytes is a destination that exists already.  The folder is any that all executors share, as a path or
a URI that pyarrow's file systems know."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.resources import published_names

SAVED = "artifact_path string, n_media int, status string, code string"


def _put(to: fs.FileSystem, path: str, data: bytes, overwrite: bool) -> bool:
    """Whether the file now holds data.  Readers see it whole or not at all."""
    if to.get_file_info(path).type != fs.FileType.NotFound:
        with to.open_input_stream(path) as f:
            if f.read() == data:
                return True
        if not overwrite:
            return False
    to.create_dir(posixpath.dirname(path), recursive=True)
    part = posixpath.join(posixpath.dirname(path), f".{uuid.uuid4().hex}.part")
    with to.open_output_stream(part) as f:
        f.write(data)
    to.move(part, path)
    return True


def save(rendered: DataFrame, folder: str, stem: Column | str, overwrite: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """rendered (from Engine.render with media_stem = stem, and manifest()) -> keep columns and where each document went.  Stems name the
    files, so two documents must not share one.  Rows that failed are passed on with their status and nothing is written."""
    stem = F.col(stem) if isinstance(stem, str) else stem
    kinds = ", ".join(f"{rendered.schema[c].name} {rendered.schema[c].dataType.simpleString()}" for c in keep)
    rows = rendered.select(*keep, "status", stem.alias("__stem"), F.col("artifact").alias("__text"), F.col("manifest").alias("__manifest"), published_names("resources", stem).alias("__names"), F.transform("resources", lambda r: F.struct(r["idx"].alias("idx"), r["content"].alias("content"))).alias("__media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            out = []
            for r in batch.select(["status", "__stem", "__text", "__manifest", "__names", "__media"]).to_pylist():
                if r["status"] != "success":
                    out.append((None, 0, r["status"], None))
                    continue
                path = posixpath.join(root, f"{r['__stem']}.md")
                media = {x["idx"]: x["content"] for x in r["__media"] or []}
                parts = [(posixpath.join(root, x["name"]), media[x["idx"]]) for x in r["__names"] or []]
                done = all(_put(to, p, data, overwrite) for p, data in [*parts, (path, r["__text"].encode()), (f"{path}.leafmill.json", r["__manifest"].encode())])
                out.append((path, len(parts), "saved" if done else "failed", None if done else "core.destination-exists"))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            made = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=[*keep, "artifact_path", "n_media", "status", "code"])

    return rows.mapInArrow(run, f"{kinds}, {SAVED}")
