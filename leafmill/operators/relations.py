"""Relations out of parsed documents, and structural validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill import schema


def blocks(parsed: DataFrame, *keys: str) -> DataFrame:
    return parsed.select(*keys, F.explode("blocks").alias("b")).select(*keys, "b.*")


def inlines(parsed: DataFrame, *keys: str) -> DataFrame:
    return parsed.select(*keys, F.explode("inlines").alias("i")).select(*keys, "i.*")


def roots(rows: DataFrame, forest: int = 0) -> DataFrame:
    """Top-level rows of a forest: 0 is the body, n is note n - 1."""
    return rows.where((F.col("forest") == forest) & F.col("parent").isNull())


def children(rows: DataFrame, parents: DataFrame, *keys: str) -> DataFrame:
    """The rows whose parent is among parents (keys, node), with that parent's number as it stands."""
    return rows.join(parents.select(*keys, F.col("node").alias("parent")), [*keys, "parent"], "left_semi")


def resources(parsed: DataFrame, *keys: str) -> DataFrame:
    return parsed.select(*keys, F.explode("resources").alias("r")).select(*keys, "r.*")


def metadata(parsed: DataFrame, *keys: str) -> DataFrame:
    return parsed.select(*keys, F.explode("metadata").alias("m")).select(*keys, "m.*")


def facets(parsed: DataFrame, kind: str, fields: str, *keys: str) -> DataFrame:
    """One facet table, its fields as columns: fields is DDL such as 'page int, x long'."""
    return parsed.select(*keys, F.explode(F.filter("facets", lambda f: f["kind"] == kind)).alias("f")).select(*keys, "f.entity", "f.ordinal", F.from_json("f.fields", fields).alias("v")).select(*keys, "entity", "ordinal", "v.*")


def containment(rows: DataFrame, *keys: str, outer: Column | None = None) -> DataFrame:
    """(keys, ancestor, node) by the interval of subtrees: every pair, so for lists of pairs; to count them use contained()."""
    a = (rows if outer is None else rows.where(outer)).select(*keys, F.col("node").alias("ancestor"), (F.col("node") + F.col("subtree_len")).alias("__end"))
    return a.join(rows.select(*keys, "node"), list(keys)).where("node > ancestor and node < __end").drop("__end")


def contained(outer: Callable[[Column], Column], inner: Callable[[Column], Column], blocks: str = "blocks") -> Column:
    """How many pairs of an outer block and an inner one under it a document has.  Subtrees are put in order as openings and closings
    and the inner blocks between them, and one pass counts what is open: n log n, within the row."""

    def events(b: Column) -> Column:
        at, end = b["node"], b["node"] + b["subtree_len"]
        none = F.lit(None).cast("struct<at:int,kind:int>")
        return F.array(F.when(outer(b), F.struct(at.alias("at"), F.lit(2).alias("kind"))).otherwise(none), F.when(outer(b), F.struct(end.alias("at"), F.lit(0).alias("kind"))).otherwise(none), F.when(inner(b), F.struct(at.alias("at"), F.lit(1).alias("kind"))).otherwise(none))

    ordered = F.array_sort(F.array_compact(F.flatten(F.transform(blocks, events))))
    zero = F.struct(F.lit(0).cast("bigint").alias("open"), F.lit(0).cast("bigint").alias("pairs"))

    def step(s: Column, e: Column) -> Column:
        return F.struct((s["open"] + F.when(e["kind"] == 2, 1).when(e["kind"] == 0, -1).otherwise(0)).alias("open"), (s["pairs"] + F.when(e["kind"] == 1, s["open"]).otherwise(0)).alias("pairs"))

    return F.aggregate(ordered, zero, step, lambda s: s["pairs"])


def shown(i: Column) -> Column:
    """What an inline gives to its block's text."""
    return F.when(i["tag"].isin("text", "code", "math"), i["text"]).when(i["tag"].isin("space", "soft_break", "hard_break"), F.lit(" ")).otherwise(F.lit(""))


def leaf_texts(tag: str, inlines: str = "inlines", blocks: str = "blocks") -> Column:
    """array of (node, level, text) of the leaf blocks of one tag, within the row."""
    return F.transform(F.filter(blocks, lambda b: b["tag"] == tag), lambda b: F.struct(b["node"].alias("node"), b["level"].alias("level"), F.array_join(F.transform(F.filter(inlines, lambda i: i["block"] == b["node"]), shown), "").alias("text")))


def subtree_text(parsed: DataFrame, *keys: str) -> DataFrame:
    """(keys, block, text) of every leaf block."""
    text = F.when(F.col("tag").isin("text", "code", "math"), F.col("text")).when(F.col("tag").isin("space", "soft_break", "hard_break"), F.lit(" "))
    return inlines(parsed, *keys).groupBy(*keys, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", text.alias("t")))), lambda x: x["t"]), "").alias("text"))


def broken(blocks: str = "blocks", inlines: str = "inlines") -> Column:
    """array of (node, rule) of whatever breaks the model: known tags, placement, payload, ranges, counts, adjacency, blanks and bad
    characters inside text.  Within the row: a block's parent is looked up by its number, which is its place as long as no
    filter took blocks out, and by search otherwise."""
    known = [*schema.BLOCK_TAGS, *schema.STRUCTURE]

    def up(b: Column) -> Column:
        there = F.get(F.col(blocks), b["parent"])
        return F.when(b["parent"].isNull(), F.lit(None)).when(there["node"] == b["parent"], there).otherwise(F.get(F.filter(blocks, lambda x: x["node"] == b["parent"]), F.lit(0)))

    def placed(tag: Column, above: Column) -> Column:
        out = tag.isin(*schema.BLOCK_TAGS) & above.isNull()
        for p, kids in schema.CONTENT.items():
            inner = tag.isin(*schema.BLOCK_TAGS) if kids == "blocks" else F.lit(False) if kids in ("inlines", "none") else tag.isin(*kids.split(","))
            out = out | ((above == p) & inner)
        return F.coalesce(out, F.lit(False))

    def of_block(pair: Column) -> Column:
        b, u, n = pair["b"], pair["u"], pair["b"]["node"]
        tag = b["tag"]
        return F.transform(F.array_compact(F.array(
            F.when(~tag.isin(*known), "unknown-tag"), F.when(~placed(tag, u["tag"]), "placement"), F.when((tag == "heading") & ~F.coalesce(b["level"].between(1, 6), F.lit(False)), "heading-level"),
            F.when(tag.isin("code_block", "raw_block") & b["text"].isNull(), "payload"), F.when(b["parent"].isNotNull() & u.isNull(), "missing-parent"), F.when(u.isNotNull() & ((u["node"] + u["subtree_len"] < n + b["subtree_len"]) | (n <= u["node"])), "range"),
            F.when(u.isNotNull() & (b["depth"] != u["depth"] + 1) | b["parent"].isNull() & (b["depth"] != 0), "depth"), F.when(b["subtree_len"] < 1, "count"), F.when((tag == "table_cell") & ((b["row_span"] < 1) | (b["col_span"] < 1)), "span"),
            F.when((tag == "extension") & (F.coalesce(F.length(b["owner"]), F.lit(0)) == 0), "extension-owner"), F.when(F.contains(F.coalesce(b["text"], F.lit("")), F.lit("\ufffd")), "replacement-character"),
            F.when((tag == "list") & ~F.coalesce(b["kind"].isin("ordered", "unordered"), F.lit(False)), "list-kind"),
        )), lambda r: F.struct(n.alias("node"), r.alias("rule")))

    def of_inline(x: Column, after: Column) -> Column:
        tag, text = x["tag"], x["text"]
        rules = F.array_compact(F.array(
            F.when(~tag.isin(*schema.INLINE_TAGS), "unknown-inline"), F.when((tag == "text") & text.rlike(r"[ \t\r\n]"), "blank-in-text"), F.when((tag == "text") & (F.coalesce(F.length(text), F.lit(0)) == 0), "empty-text"),
            F.when(tag.isin("code", "math", "raw") & text.isNull(), "payload"), F.when((tag == "note") & x["note"].isNull(), "note-number"), F.when(F.contains(F.coalesce(text, F.lit("")), F.lit("\ufffd")), "replacement-character"),
        ))
        own = F.transform(rules, lambda r: F.struct(x["node"].alias("node"), r.alias("rule")))
        # Text has nothing under it, so the next row with the same parent is its neighbour.
        beside = (tag == "text") & (after["tag"] == "text") & (x["block"] == after["block"]) & x["parent"].eqNullSafe(after["parent"])
        return F.concat(own, F.when(F.coalesce(beside, F.lit(False)), F.array(F.struct(after["node"].alias("node"), F.lit("adjacent-text").alias("rule")))).otherwise(F.array().cast("array<struct<node:int,rule:string>>")))

    b = F.flatten(F.transform(F.transform(blocks, lambda b: F.struct(b.alias("b"), up(b).alias("u"))), of_block))
    i = F.flatten(F.zip_with(inlines, F.slice(inlines, 2, F.greatest(F.size(inlines), F.lit(1))), of_inline))
    return F.concat(b, i)


def violations(parsed: DataFrame, *keys: str) -> DataFrame:
    """(keys, node, rule) of whatever breaks the model; nothing is shuffled, and the documents are read once."""
    return parsed.select(*keys, F.explode(broken()).alias("v")).select(*keys, "v.node", "v.rule")


def side_violations(parsed: DataFrame, *keys: str) -> DataFrame:
    """(keys, entity, rule): facets bound to no node, links and images that name no resource, embedded resources without
    their digest, notes that are referred to but missing."""
    nodes = blocks(parsed, *keys).where("entity is not null").select(*keys, "entity").unionByName(inlines(parsed, *keys).where("entity is not null").select(*keys, "entity"))
    bound = parsed.select(*keys, F.explode("facets").alias("f")).select(*keys, "f.entity")
    loose = bound.join(nodes, [*keys, "entity"], "left_anti").select(*keys, "entity", F.lit("unbound-facet").alias("rule"))
    have = resources(parsed, *keys)
    named = inlines(parsed, *keys).where("resource is not null").select(*keys, F.col("resource").alias("idx"))
    missing = named.join(have.select(*keys, "idx"), [*keys, "idx"], "left_anti").select(*keys, F.col("idx").alias("entity"), F.lit("unknown-resource").alias("rule"))
    bare = have.where("kind = 'embedded' and (digest is null or digest <> sha2(content, 256))").select(*keys, F.col("idx").alias("entity"), F.lit("digest").alias("rule"))
    notes = inlines(parsed, *keys).where("tag = 'note'").select(*keys, (F.col("note") + 1).alias("forest"))
    lost = notes.join(blocks(parsed, *keys).select(*keys, "forest").distinct(), [*keys, "forest"], "left_anti").select(*keys, F.col("forest").alias("entity"), F.lit("missing-note").alias("rule"))
    return loose.unionByName(missing).unionByName(bare).unionByName(lost)


def envelope() -> Column:
    """A conversion as one line of JSON: keys in order, absent values left out."""
    return F.to_json(F.struct(F.col("markdown").alias("artifact"), "format", "name", "reports", "status"))
