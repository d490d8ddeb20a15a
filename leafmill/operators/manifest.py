"""The canonical manifest of a conversion, stale ones, and what they carry over.

Keys stand in sorted order, without white space, times or paths.  Digests are SHA-256, and say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA, VERSION = "leafmill.manifest", 1
MOST_BYTES = 16 << 20


def digest(content: Column) -> Column:
    return F.struct(F.lit("sha256").alias("algorithm"), F.sha2(content.cast("binary"), 256).alias("hex"))


def facet_summary(facets: str = "facets") -> Column:
    """Each kind with its count and the digest of its rows."""
    kinds = F.array_sort(F.array_distinct(F.transform(facets, lambda f: f["kind"])))

    def one(k: Column) -> Column:
        own = F.filter(facets, lambda f: f["kind"] == k)
        text = F.array_join(F.transform(own, lambda f: F.concat_ws(":", f["entity"].cast("string"), f["fields"])), "\n")
        return F.struct(F.size(own).alias("count"), F.sha2(text.cast("binary"), 256).alias("digest"), k.alias("kind"))

    return F.transform(kinds, one)


def manifest(rendered: DataFrame, content: Column) -> DataFrame:
    """rendered (from Engine.render) and the source's bytes -> with a manifest column."""
    meta = F.map_from_entries(F.array_sort(F.transform(F.filter("metadata", lambda m: ~F.exists("metadata", lambda n: (n["key"] == m["key"]) & (n["ordinal"] < m["ordinal"]))), lambda m: F.struct(m["key"], m["value"]))))
    media = F.transform(F.filter("resources", lambda r: r["kind"] == "embedded"), lambda r: F.struct(r["digest"], r["mime"].alias("mime"), r["pixel_height"].alias("pixel_height"), r["pixel_width"].alias("pixel_width"), r["source"].alias("source")))
    reports = F.transform("reports", lambda r: F.struct(r["code"].alias("code"), r["consequence"].alias("consequence"), r["contexts"].alias("contexts"), r["count"].alias("count"), r["loss"].alias("loss"), r["severity"].alias("severity")))
    body = F.struct(
        digest(F.col("artifact")).alias("artifact"), F.struct(F.size("blocks").alias("blocks"), F.size("inlines").alias("inlines")).alias("ast"), meta.alias("document_metadata"), facet_summary().alias("facets"),
        media.alias("media"), F.transform("plugins", lambda p: F.struct(p["data"].alias("data"), p["id"].alias("id"), p["version"].alias("version"))).alias("plugins"), reports.alias("reports"),
        F.lit(SCHEMA).alias("schema"), F.lit(VERSION).alias("schema_version"), F.struct(digest(content).alias("digest"), F.col("format").alias("format")).alias("source"),
    )
    return rendered.withColumn("manifest", F.to_json(body))


def fresh(current: DataFrame, sidecars: DataFrame) -> DataFrame:
    """current (doc_id, digest hex of the source), sidecars (doc_id, manifest json) -> doc_id, state, code, plugins.  A missing manifest
    is fine; one that is too large, malformed, of another schema or of other bytes is ignored with a warning."""
    shape = "struct<plugins:array<struct<data:string,id:string,version:int>>,schema:string,schema_version:int,source:struct<digest:struct<algorithm:string,hex:string>>>"
    read = sidecars.select("doc_id", "manifest", F.from_json("manifest", shape).alias("m"))
    both = current.join(read, "doc_id", "left")
    ok = (F.col("m.schema") == SCHEMA) & (F.col("m.schema_version") == VERSION)
    state = (
        F.when(F.col("manifest").isNull(), "missing").when(F.octet_length("manifest") > MOST_BYTES, "too-large").when(F.col("m").isNull() | ~F.coalesce(ok, F.lit(False)), "malformed")
        .when(F.col("m.source.digest.hex") != F.col("digest"), "stale").otherwise("fresh")
    )
    code = F.when(~state.isin("fresh", "missing"), "core.stale-or-invalid-manifest")
    return both.withColumns({"state": state, "code": code}).select("doc_id", "state", "code", F.when(state == "fresh", F.col("m.plugins")).alias("plugins"))


def carry(new: Column | str, old: Column | str) -> Column:
    """Plugin data: the new document's own entries, then old ones that it has none of."""
    new, old = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<struct<id:string,version:int,data:string>>")) for c in (new, old))
    return F.concat(new, F.filter(old, lambda o: ~F.exists(new, lambda n: n["id"] == o["id"])))
