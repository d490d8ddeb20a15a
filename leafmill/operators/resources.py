"""Published names of resources: <stem>_media/image-N.ext over the embedded ones, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# File endings of media types.
ENDINGS = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/bmp": "bmp", "image/tiff": "tiff", "image/webp": "webp", "image/svg+xml": "svg", "image/x-emf": "emf", "image/x-wmf": "wmf", "image/jp2": "jp2"}
MIMES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "svg": "image/svg+xml", "emf": "image/x-emf", "wmf": "image/x-wmf", "jp2": "image/jp2"}


def ending(mime: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for m, e in ENDINGS.items():
        out = out.when(mime == m, F.lit(e))
    return out.otherwise(F.lit("bin"))


def published_names(resources: str, stem: Column) -> Column:
    """array of (idx, name) for the embedded resources of one document's array."""
    own = F.filter(resources, lambda r: r["kind"] == "embedded")
    return F.transform(own, lambda r, i: F.struct(r["idx"].alias("idx"), F.concat(stem, F.lit("_media/image-"), (i + 1).cast("string"), F.lit("."), ending(r["mime"])).alias("name")))


def resource_rows(resources: DataFrame, stem: Column) -> DataFrame:
    """The same over an exploded relation (doc_id, idx, mime, kind, ..): embedded ones get a name."""
    order = Window.partitionBy("doc_id", F.col("kind") == "embedded").orderBy("idx", "mime")
    name = F.concat(stem, F.lit("_media/image-"), F.row_number().over(order).cast("string"), F.lit("."), ending(F.col("mime")))
    return resources.withColumn("name", F.when(F.col("kind") == "embedded", name))


def first_wins(resources: DataFrame) -> DataFrame:
    """Of rows with one (doc_id, source), the one with the least ordinal."""
    return resources.groupBy("doc_id", "source").agg(F.min_by(F.struct(*[c for c in resources.columns if c not in ("doc_id", "source")]), "idx").alias("r")).select("doc_id", "source", "r.*")
