"""Mixing sources to target weights: hierarchical budgeting and seeded epochs.

The tree is a list of column names from the root down (domain, language, source); a leaf is one value of each.
A token budget goes down the tree by weight.  A node can take no more than its leaves' tokens times
``max_epochs``; what it cannot take goes to its siblings by weight, and only what all of them cannot take is
missing at the parent, whose own siblings take it: giving each node the least of its share and its
subtree's capacity, level by level from the root, does exactly that.  Shares are whole numbers of tokens.
Only nodes are ranked, never rows: the children of one node share a window that sorts one small row a child and
spills to disk if there are very many.

A leaf with budget b and t tokens gives b div t whole epochs and a prefix of the next one: its documents
in the order of md5(seed:epoch:doc_id), as long as their tokens fit in b mod t.  The prefix ends are found by
descending the hash, two hex digits a pass, so that no leaf, be it a third of all rows, is ever sorted or
gathered: a pass sums tokens over at most 256 values a leaf, and the last looks at one small interval.

Nulls and edge cases: a null level value is a leaf value of its own; a null text has no token; a null
doc_id hashes like the text 'null'; rows of one doc_id enter a prefix together; unknown values weigh
``default_weight``; an empty table gives an empty result; weight 0 takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import packed, stage, unpacked

#: A table of leaves with at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_LEAVES = 50_000
_DIGITS = 32
_PLAN = ("tokens", "budget", "full", "cut", "rest", "prefix")


def n_tokens(text: Column | str = "text") -> Column:
    """Words [^\\x20\\x09-\\x0D]+."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(column: str, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for value, w in weights.items():
        out = F.when(F.col(column) == value, w).otherwise(out)
    return out.cast("decimal(18,0)")


def _share(children: DataFrame, parent: list[str]) -> DataFrame:
    """children (.., w, cap, budget of the parent): give = what each child gets.  Children are filled from
    the one that saturates first; those left share the rest by weight."""
    order = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col("w")).asc(), *[F.col(c).asc_nulls_first() for c in children.columns if c not in ("cap", "w", "budget")])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy(*parent)
    zero = F.lit(0).cast("decimal(38,0)")
    t = children.where("w > 0").withColumns({"p": F.coalesce(F.sum("cap").over(before), zero), "pw": F.coalesce(F.sum("w").over(before), zero), "tw": F.sum("w").over(all_of)})
    left, weight = F.col("budget") - F.col("p"), F.col("tw") - F.col("pw")
    t = t.withColumn("full", F.col("cap").cast("double") * weight.cast("double") <= left.cast("double") * F.col("w").cast("double"))
    t = t.withColumns({"sc": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(all_of), zero), "sw": F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(all_of), zero)})
    part = F.floor((F.col("budget") - F.col("sc")).cast("decimal(20,0)") * F.col("w") / (F.col("tw") - F.col("sw")))
    given = F.when(F.col("full"), F.col("cap")).otherwise(F.least(part, F.col("cap")))
    return t.withColumn("give", given.cast("decimal(28,0)"))


def allocate(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: int, max_epochs: int, default_weight: int = 1) -> DataFrame:
    """leaves (levels.., tokens) -> levels.., tokens, budget (tokens to take, at most tokens * max_epochs)."""
    top = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("decimal(28,0)"))
    given = None
    for i, level in enumerate(levels):
        path = levels[: i + 1]
        nodes = top.groupBy(*path).agg(F.sum("cap").cast("decimal(28,0)").alias("cap")).withColumn("w", _weight(level, weights.get(level, {}), default_weight))
        if given is None:
            nodes = nodes.withColumn("budget", F.lit(budget).cast("decimal(28,0)"))
        else:
            cond = None
            for c in levels[:i]:
                x = nodes[c].eqNullSafe(given[c])
                cond = x if cond is None else cond & x
            nodes = nodes.join(given, cond).select(*[nodes[c] for c in [*path, "cap", "w"]], given["give"].alias("budget"))
        given = stage(_share(nodes, levels[:i]).select(*path, "give"))
    cond = None
    for c in levels:
        x = leaves[c].eqNullSafe(given[c])
        cond = x if cond is None else cond & x
    return leaves.join(given, cond).select(*[leaves[c] for c in [*levels, "tokens"]], given["give"].cast("long").alias("budget"))


def _place(seed: int, id_col: str = "doc_id") -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("full") + 1).cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def _with_leaf(rows: DataFrame, plan: DataFrame, levels: list[str], leaves: int) -> DataFrame:
    cond = None
    for c in levels:
        x = rows[c].eqNullSafe(plan[c])
        cond = x if cond is None else cond & x
    rest = [plan[c] for c in plan.columns if c not in levels]
    return rows.join(F.broadcast(plan) if leaves <= BROADCAST_LEAVES else plan, cond).select(*[rows[c] for c in rows.columns], *rest)


def plan_mix(rows: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: int | None, share: float, max_epochs: int, seed: int, default_weight: int = 1) -> tuple[DataFrame, int]:
    """rows (doc_id, levels.., n_tokens), written already -> the plan (levels.., tokens, budget, full, cut):
    ``full`` whole epochs, then the documents whose place in the next is at most ``cut`` ('': none)."""
    leaves = stage(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")))
    count, total = leaves.agg(F.count("*"), F.sum("tokens")).first()
    budget = int(share * (total or 0)) if budget is None else budget
    plan = allocate(leaves, levels, weights, budget, max_epochs, default_weight)
    plan = plan.withColumn("full", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0).cast("long")))
    plan = stage(plan.withColumn("rest", F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(F.lit(0).cast("long"))))
    state = plan.where("rest > 0").select(*levels, "full", "rest", F.lit("").alias("prefix"))
    for digit in range(0, _DIGITS, 2):
        near = _with_leaf(rows.select("doc_id", *levels, "n_tokens"), state, levels, count).withColumn("at", _place(seed)).where("startswith(at, prefix)")
        last = digit + 2 >= _DIGITS
        step = F.substring("at", digit + 1, 2)
        sums = near.groupBy(*levels, "full", "rest", "prefix", step.alias("step")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
        up_to = Window.partitionBy(*levels).orderBy("step")
        sums = sums.withColumn("c", F.sum("t").over(up_to))
        over = sums.where("c > rest")
        first = over.groupBy(*levels).agg(F.min_by(F.struct("full", (F.col("rest") - (F.col("c") - F.col("t"))).alias("rest"), F.concat("prefix", "step").alias("prefix"), "n"), "step").alias("x"))
        state = stage(first.select(*levels, "x.*"))
        most = state.agg(F.max("n")).first()[0] or 0
        if most <= 1000 or last:
            break
    state = state.drop("n")
    near = _with_leaf(rows.select("doc_id", *levels, "n_tokens"), state, levels, count).withColumn("at", _place(seed)).where("startswith(at, prefix)")
    units = near.groupBy(*levels, "rest", "prefix", "at").agg(F.sum("n_tokens").alias("t"))
    units = units.withColumn("c", F.sum("t").over(Window.partitionBy(*levels).orderBy("at")))
    cuts = units.groupBy(*levels, "prefix").agg(F.max(F.when(F.col("c") <= F.col("rest"), F.col("at"))).alias("at")).select(*levels, F.coalesce("at", "prefix").alias("cut"))
    cond = None
    for c in levels:
        x = plan[c].eqNullSafe(cuts[c])
        cond = x if cond is None else cond & x
    out = plan.join(cuts, cond, "left").select(*[plan[c] for c in plan.columns if c != "rest"], F.coalesce(cuts["cut"], F.lit("")).alias("cut"))
    return stage(out), count


def copies(seed: int) -> Column:
    return (F.col("full") + F.when((F.col("cut") != "") & (_place(seed) <= F.col("cut")), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: int | None = None, share: float = 0.5, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """Per row of docs that is taken at least once: doc_id, levels.., n_tokens, copies."""
    rows = stage(docs.select("doc_id", *levels, n_tokens().alias("n_tokens")))
    plan, leaves = plan_mix(rows, levels, weights, budget, share, max_epochs, seed)
    both = _with_leaf(rows, plan, levels, leaves).withColumn("copies", copies(seed))
    return both.where("copies > 0").select("doc_id", *levels, "n_tokens", "copies")


def take_mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], budget: int | None = None, share: float = 0.5, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """The rows of docs, with its columns, each as often as it is taken.  levels: name -> column of docs."""
    names = list(levels)
    if {"d", "doc_id", "n_tokens", *_PLAN} & set(names):
        raise ValueError("a level's name is one that the plan uses")
    base = packed(docs, doc_id=F.col("doc_id"), **levels)
    rows = stage(docs.select("doc_id", *[c.alias(n) for n, c in levels.items()], n_tokens().alias("n_tokens")))
    plan, leaves = plan_mix(rows, names, weights, budget, share, max_epochs, seed)
    both = _with_leaf(base, plan, names, leaves).withColumn("copies", copies(seed)).where("copies > 0")
    return unpacked(both.select("d", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)
