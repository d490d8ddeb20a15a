"""Chat formatting by quotation linking.

Every message is cut into runs of lines of one quote level (the number of ``>`` before a line; blanks may stand
between them).  Level 0 is the message's own text; a run of a higher level is a quoted passage.  Passages are
normalised (A-Z in lower case, white space to single spaces) and hashed, as a whole and line by line, and joined to
the own runs and lines of messages of the same conversation.  A message's parent is the earlier message that
has most of its outermost quoted words, the latest one on ties; deeper levels count only if no outer one
is found.  Roots of reply chains come from pointer jumping, a number of joins that grows with the logarithm of
the longest chain.  A conversation is read in the order (thread_root, turn), which puts every reply behind
its parent, with quotes taken out.

Where a passage stands in several messages the first is its origin, so the join is many to one, and a
conversation with a third of all messages is no group that anything gathers.

Nulls and edge cases: a null text has no lines; a null conv_id or turn links to nothing; rows alike in
conv_id and turn share parents but keep their texts; a passage of white space alone is none; an empty table
gives an empty one; of origins with equally many words the latest is the parent; a very long text is parsed line by line and
leaves a hash a line; columns besides conv_id, turn, role and text are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import stage, tidy

_QUOTE = re.compile(r"[ \t]*((?:>[ \t]*)+)")
_UNIT = pa.struct([("level", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("words", pa.int32())])


def parse(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """The own text without quotes, and the runs of lines: (level, lines)."""
    runs: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = _QUOTE.match(line)
        level, rest = (m.group(1).count(">"), line[m.end() :]) if m else (0, line)
        if runs and runs[-1][0] == level:
            runs[-1][1].append(rest)
        else:
            runs.append((level, [rest]))
    own = "\n".join("\n".join(lines) for level, lines in runs if level == 0)
    return own.strip(" \t\n\x0b\f\r"), runs


def normal(text: str) -> bytes:
    return b" ".join(text.encode().lower().split())


def units(runs: list[tuple[int, list[str]]]) -> list[tuple[int, int, int, int]]:
    """(level, hash, hash, words) of each distinct run, paragraph and line that has a word."""
    out = {}
    for level, lines in runs:
        pieces = {normal("\n".join(lines)), *map(normal, lines), *(normal(p) for p in "\n".join(lines).split("\n\n"))}
        for x in pieces:
            if x:
                h = xxhash.xxh3_128_intdigest(x)
                h1, h2 = h >> 64, h & (1 << 64) - 1
                out[level, x] = (level, h1 - (1 << 63), h2 - (1 << 63), x.count(b" ") + 1)
    return list(out.values())


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body (own text), units (array of level, h1, h2, words)."""
    kinds = {c: messages.schema[c].dataType.simpleString() for c in ("conv_id", "turn", "role")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, found = [], []
            for x in batch.column("text"):
                own, runs = parse(x.as_py() or "")
                body.append(own)
                found.append([dict(zip(("level", "h1", "h2", "words"), u, strict=True)) for u in units(runs)])
            yield pa.record_batch({c: batch.column(c) for c in kinds} | {"body": pa.array(body, pa.string()), "units": pa.array(found, pa.list_(_UNIT))})

    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", body string, units array<struct<level:int,h1:long,h2:long,words:int>>"
    return messages.select("conv_id", "turn", "role", "text").mapInArrow(tidy(run), schema)


def parents(rows: DataFrame) -> DataFrame:
    """parsed messages -> (conv_id, turn, parent, quoted words found) of those with a parent."""
    each = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("units").alias("u")).select("conv_id", "turn", "u.*")
    quoted = each.where("level > 0")
    key = ["conv_id", "h1", "h2"]
    asked = stage(quoted.groupBy(*key, "turn", "level").agg(F.max("words").alias("words")))
    if asked.isEmpty():
        return asked.select("conv_id", "turn", F.col("turn").alias("parent"), F.col("words").cast("long").alias("found"))
    origins = stage(each.where("level = 0").groupBy(*key).agg(F.min("turn").alias("origin")))
    hits = asked.join(origins, key).where("origin < turn").groupBy("conv_id", "turn", "level", "origin").agg(F.sum("words").alias("found"))
    best = hits.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("o"), "found", "origin")).alias("b"))
    return stage(best.select("conv_id", "turn", F.col("b.origin").alias("parent"), F.col("b.found").alias("found")))


def roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent) -> (conv_id, turn, root, depth) by pointer jumping."""
    now = links.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth"))
    while True:
        up = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root").alias("r"), F.col("depth").alias("d"))
        both = now.join(up, (now["conv_id"] == up["c"]) & (now["root"] == up["t"]), "left")
        moved = stage(both.select("conv_id", "turn", F.coalesce("r", "root").alias("root"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("r").isNotNull().alias("moved")))
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now


def link_quotes(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, parent_turn (null: none), thread_root, depth, n_quotes (distinct quoted
    pieces), body; sorted by conversation in reply order within the output's partitions."""
    rows = stage(parsed(messages))
    links = parents(rows)
    found = links.join(roots(links), ["conv_id", "turn"]).select("conv_id", "turn", "parent", "root", "depth")
    both = rows.join(found, ["conv_id", "turn"], "left")
    out = both.select("conv_id", "turn", "role", F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("thread_root"), F.coalesce("depth", F.lit(0)).alias("depth"), F.expr("size(filter(units, u -> u.level > 0))").alias("n_quotes"), "body")
    order = ["conv_id", "thread_root", "turn"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)
