"""Tree filters over parsed documents: built-in ones as array expressions, others as functions of a tree.

A filter is a function DataFrame -> DataFrame, so a pipeline is df.transform(f).transform(g).  Filters see the body, not
the notes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill import schema
from leafmill.functions.tree import INLINE_LEAVES, Document, Node, flatten, plain_text, unflatten
from leafmill.operators import relations

Filter = Callable[[DataFrame], DataFrame]
MOST_STAGES = 32
KEEP, DROP, UNWRAP = "keep", "drop", "unwrap"


@dataclass(frozen=True)
class Described:
    """A filter with what a pipeline and its users want to know of it.  block_tags and inline_tags: what it looks at (empty: all)."""

    run: Filter
    id: str
    description: str = ""
    options: tuple[tuple[str, str], ...] = ()
    order: str = "top-down"
    block_tags: tuple[str, ...] = ()
    inline_tags: tuple[str, ...] = ()
    idempotent: bool = False

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[a-z0-9]+([.-][a-z0-9]+)+", self.id):
            raise ValueError(f"a filter's id is words joined by dots, such as team.filter: {self.id!r}")
        if self.order not in ("top-down", "bottom-up"):
            raise ValueError("order is top-down or bottom-up")
        unknown = {*self.block_tags} - {*schema.BLOCK_TAGS, *schema.STRUCTURE} | {*self.inline_tags} - {*schema.INLINE_TAGS}
        if unknown:
            raise ValueError(f"no such tags: {sorted(unknown)}")

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.run(df)


def checked(df: DataFrame, name: str) -> DataFrame:
    """Documents that break the model fail, with a report that names the filter after which they did."""
    bad = F.col("__broken")
    note = F.struct(
        F.size("reports").alias("seq"), F.lit("core.filter-broke-document").alias("code"), F.lit("failure").alias("severity"), F.get(bad, F.lit(0))["rule"].alias("consequence"), F.lit("none").alias("loss"), F.lit("").alias("directions"),
        F.lit("conversion").alias("exit_class"), F.size(bad).cast("bigint").alias("count"), F.array(F.lit(name)).alias("contexts"),
    )
    hit = (F.col("status") == "success") & (F.size(bad) > 0)
    out = df.withColumn("__broken", relations.broken())
    return out.withColumns({"reports": F.when(hit, F.array_append("reports", note)).otherwise(F.col("reports")), "status": F.when(hit, "failed").otherwise(F.col("status"))}).select(*df.columns)


def pipeline(*filters: Filter, validate: bool = True) -> Filter:
    """At most 32 filters, in order.  Documents are validated after each, unless told otherwise."""
    if len(filters) > MOST_STAGES:
        raise ValueError(f"a pipeline has at most {MOST_STAGES} stages")
    ids = [f.id for f in filters if isinstance(f, Described)]
    if len({*ids}) < len(ids):
        raise ValueError(f"two filters share an id: {sorted(i for i in ids if ids.count(i) > 1)}")

    def run(df: DataFrame) -> DataFrame:
        for k, f in enumerate(filters):
            df = df.transform(f)
            if validate:
                df = checked(df, f.id if isinstance(f, Described) else f"filter {k + 1}")
        return df

    return run


def shift_headings(by: int) -> Filter:
    def level(b: Column) -> Column:
        return F.when((b["tag"] == "heading") & (b["forest"] == 0), b.withField("level", F.greatest(F.lit(1), F.least(F.lit(6), b["level"] + by)))).otherwise(b)

    return lambda df: df.withColumn("blocks", F.transform("blocks", level))


def strip_classes(pattern: str) -> Filter:
    """Take out the class, or with a final * all that begin so; attributes that end up empty go."""
    prefix = pattern[:-1] if pattern.endswith("*") else None

    def out(c: Column) -> Column:
        return F.startswith(c, F.lit(prefix)) if prefix is not None else c == pattern

    def strip(x: Column) -> Column:
        left = F.filter(x["attrs"]["classes"], lambda c: ~out(c))
        attrs = x["attrs"].withField("classes", left)
        empty = (F.length(x["attrs"]["id"]) == 0) & (F.size(left) == 0) & (F.size(x["attrs"]["pairs"]) == 0)
        touched = (x["forest"] == 0) & x["attrs"].isNotNull() & F.exists(x["attrs"]["classes"], out)
        return F.when(~touched | x["attrs"].isNull(), x).otherwise(x.withField("attrs", F.when(~empty, attrs)))

    return lambda df: df.withColumns({"blocks": F.transform("blocks", strip), "inlines": F.transform("inlines", strip)})


def promote_first_heading(df: DataFrame) -> DataFrame:
    """If the body begins with a heading of level 1, its text becomes the title and it goes."""
    first = F.element_at(F.filter("blocks", lambda b: b["forest"] == 0), 1)
    node = F.when((F.size(F.filter("blocks", lambda b: b["forest"] == 0)) > 0) & (first["tag"] == "heading") & (first["level"] == 1), first["node"])
    base = df.withColumn("__first", node)
    own = F.filter("inlines", lambda i: i["block"] == F.col("__first"))
    text = F.array_join(F.transform(own, lambda i: F.when(i["tag"].isin("text", "code", "math"), i["text"]).when(i["tag"].isin("space", "soft_break", "hard_break"), " ").otherwise("")), "")
    entry = F.struct(F.size("metadata").alias("ordinal"), F.lit("title").alias("key"), F.lit("inlines").alias("value_type"), text.alias("value"))
    hit = F.col("__first").isNotNull()
    out = base.withColumns({
        "metadata": F.when(hit, F.array_append(F.filter("metadata", lambda m: m["key"] != "title"), entry)).otherwise(F.col("metadata")),
        "blocks": F.filter("blocks", lambda b: ~hit | (b["node"] != F.col("__first"))), "inlines": F.filter("inlines", lambda i: ~hit | (i["block"] != F.col("__first"))),
    })
    return out.select(*df.columns)


class Context:
    """What a visitor may change of a document beside the node that it is at."""

    def __init__(self, doc: Document):
        self._doc = doc
        self.metadata: list[tuple[str, str, str]] = []

    def set_meta(self, key: str, value: str | list[Node]) -> None:
        """Text, or inlines, of which the text is kept; the entry takes the place of one with its key."""
        self.metadata = [m for m in self.metadata if m[0] != key] + [(key, "string", value) if isinstance(value, str) else (key, "inlines", plain_text(value))]

    def report(self, code: str, severity: str = "note", consequence: str = "", loss: str = "none", context: str | None = None) -> None:
        self._doc.report(code, severity, consequence, loss, context)

    @staticmethod
    def link_target(node: Node, url: str) -> Node:
        node.p["url"] = url
        return node

    @staticmethod
    def heading_level(node: Node, level: int) -> Node:
        node.p["level"] = min(max(level, 1), 6)
        return node

    @staticmethod
    def attrs(node: Node, id: str = "", classes: tuple[str, ...] = (), pairs: tuple[tuple[str, str], ...] = ()) -> Node:
        node.attrs = {"id": id, "classes": list(classes), "pairs": list(pairs)} if id or classes or pairs else None
        return node


def tree_filter(visit_block: Callable[..., str | Node] | None = None, visit_inline: Callable[..., str | Node] | None = None, finish: Callable[[Document], None] | None = None, with_context: bool = False) -> Filter:
    """A filter from visitors.  Each gives keep, drop, unwrap (children take the node's place) or a node to put in its
    place; children of dropped and replaced nodes are not visited.  visit_block also gets the enclosing blocks; with_context: both
    get a Context as well."""
    now: list[Context] = []

    def more() -> list[Context]:
        return now[-1:] if with_context else []

    def blocks(kids: list[Node], above: list[Node]) -> list[Node]:
        out: list[Node] = []
        for k in kids:
            says = visit_block(k, above, *more()) if visit_block else KEEP
            if isinstance(says, Node):
                out.append(says)
            elif says != DROP:
                if k.tag in INLINE_LEAVES:
                    k.kids = inlines(k.kids)
                else:
                    k.kids = blocks(k.kids, above if says == UNWRAP else [*above, k])
                out += k.kids if says == UNWRAP and k.tag not in INLINE_LEAVES else [k]
        return out

    def inlines(kids: list[Node]) -> list[Node]:
        out: list[Node] = []
        for k in kids:
            says = visit_inline(k, *more()) if visit_inline else KEEP
            if isinstance(says, Node):
                new = [says]
            elif says == DROP:
                new = []
            else:
                k.kids = inlines(k.kids)
                new = k.kids if says == UNWRAP else [k]
            for x in new:
                if x.tag == "text" and out and out[-1].tag == "text":
                    out[-1] = Node("text", text=out[-1].text + x.text)
                else:
                    out.append(x)
        return out

    def apply(df: DataFrame) -> DataFrame:
        from leafmill.operators.convert import BATCH, arrow_schema, report_rows

        cols = df.columns
        types = arrow_schema(f"blocks array<{schema.BLOCK}>, inlines array<{schema.INLINE}>, metadata array<{schema.METADATA}>, reports array<{schema.REPORT}>")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, BATCH):
                    batch = whole.slice(a, BATCH)
                    rows = []
                    for r in batch.select(["blocks", "inlines", "metadata", "reports"]).to_pylist():
                        doc = unflatten(r["blocks"], r["inlines"])
                        now[:] = [Context(doc)]
                        doc.body = blocks(doc.body, [])
                        if finish:
                            finish(doc)
                        b, i = flatten(doc)
                        new = report_rows(doc)
                        for k, x in enumerate(new):
                            x["seq"] = len(r["reports"]) + k
                        set_here = now[0].metadata
                        meta = [m for m in r["metadata"] if m["key"] not in {k for k, *_ in set_here}]
                        meta += [{"ordinal": len(r["metadata"]) + k, "key": key, "value_type": kind, "value": value} for k, (key, kind, value) in enumerate(set_here)]
                        rows.append({"blocks": b, "inlines": i, "metadata": meta, "reports": r["reports"] + new})
                    made = pa.RecordBatch.from_pylist(rows, schema=types)
                    yield pa.RecordBatch.from_arrays([made.column(c) if c in made.schema.names else batch.column(c) for c in cols], names=cols)

        return df.mapInArrow(run, df.schema)

    return apply


def drop_empty_containers() -> Filter:
    """Containers and spans without attributes give way to their children."""
    return tree_filter(lambda b, _: UNWRAP if b.tag == "container" and not b.attrs else KEEP, lambda i: UNWRAP if i.tag == "span" and not i.attrs else KEEP)


def flatten_nested_tables(placeholder: str = "(nested table)") -> Filter:
    """A table in a cell becomes a paragraph, with a warning that counts them."""

    class Count:
        n = 0

    def visit(b: Node, above: list[Node]) -> str | Node:
        if b.tag == "table" and any(x.tag == "table_cell" for x in above):
            Count.n += 1
            return Node("paragraph", kids=words(placeholder))
        return KEEP

    def finish(doc: Document) -> None:
        if Count.n:
            doc.report("core.nested-table-flattened", "warning", "nested tables became placeholders", "dropped", count=Count.n)
        Count.n = 0

    return tree_filter(visit, finish=finish)


def words(text: str) -> list[Node]:
    out: list[Node] = []
    for w in text.split():
        out += [Node("space"), Node("text", text=w)] if out else [Node("text", text=w)]
    return out


def replace_link_target(change: Callable[[str], str]) -> Filter:
    def visit(i: Node) -> str:
        if i.tag in ("link", "image"):
            i.p["url"] = change(i.p.get("url") or "")
        return KEEP

    return tree_filter(visit_inline=visit)


def with_class(relation: str, name: str) -> Column:
    """Of blocks or inlines: those that have a class."""
    return F.filter(relation, lambda x: F.array_contains(x["attrs"]["classes"], name))


__all__ = ["DROP", "KEEP", "UNWRAP", "Context", "Described", "Filter", "checked", "drop_empty_containers", "flatten_nested_tables", "pipeline", "promote_first_heading", "replace_link_target", "shift_headings", "strip_classes", "tree_filter", "with_class", "words"]
