"""Line dedup: drop lines whose key stands in many documents.  DataFrame functions only.

A line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends, with A-Z in lower case.  Keys of at least
``min_chars`` code points found in at least ``min_docs`` documents (rows) lose all their lines everywhere.

Plan: (1) each row yields the distinct hashes of its keys, which a partial aggregate counts, so a line that
stands in a third of all documents costs one row a task; (2) the frequent hashes, a small table, meet the
exploded (row, position, hash) triples in an equi-join that carries no text; (3) the positions found are
gathered by document and the kept lines put together by position.  The text moves once.  Keys are
compared by two differently seeded 64-bit hashes.

Null or empty text: one empty line, whose key has no code point and so is never dropped if min_chars >= 1.
Rows alike in doc_id and text count as two documents and get equal results.  A null doc_id is a value like
any other.  An empty table gives an empty one.  A text of very many lines is exploded once, by line.  A key in exactly ``min_docs``
documents goes.  Other columns, whatever their names, are passed through by ``drop_frequent_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import packed, same_key, stage, text_key

KEY = ["id", "tk"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(lines: Column) -> Column:
    """Lines -> keys.  Each step is an array of its own, so that no lambda works out a value twice.  lower() is exact for
    ASCII-only text and much quicker; other text has its A-Z replaced alone."""
    bare = F.transform(lines, lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")))
    return F.transform(bare, lambda x: F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, _UPPER, _LOWER)))


def _hashed(keys: Column, min_chars: int) -> Column:
    """Null for keys too short to drop."""
    long_enough = (lambda x: x != "") if min_chars == 1 else (lambda x: F.char_length(x) >= min_chars)
    return F.transform(keys, lambda x: F.when(long_enough(x), F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"))))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def marked(docs: DataFrame, min_docs: int, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as a struct d, with lines and drop, the positions of the lines to drop (null: none)."""
    keyed = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("tk"), _hashed(line_keys(_lines(F.col(text_col))), min_chars).alias("hs"))
    each = keyed.select(F.explode(F.array_distinct("hs")).alias("h")).where("h is not null").select("h.*")
    frequent = stage(each.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2"))
    placed = keyed.select("id", "tk", F.posexplode("hs").alias("pos", "h")).where("h is not null").select("id", "tk", "pos", "h.*")
    found = placed.join(frequent, ["h1", "h2"]).groupBy(*KEY).agg(F.collect_set("pos").alias("drop"))
    base = packed(docs, id=F.col(id_col), tk=text_key(text_col), lines=_lines(F.col(text_col)))
    return base.join(found, same_key(base, found, KEY), "left").select(base["d"], base["lines"], found["drop"])


def _kept(lines: str = "lines", drop: str = "drop") -> Column:
    """What stays, by position; null if no line stays.  Linear in the number of lines."""
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    some = F.array_join(F.transform(places, lambda i: F.element_at(F.col(lines), i + 1)), "\n")
    return F.when(F.col(drop).isNull(), F.array_join(lines, "\n")).when(F.size(places) > 0, some)


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_text ('' if no line stays)."""
    out = marked(docs.select("doc_id", "text"), min_docs, min_chars)
    dropped = F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop"))
    return out.select("d.doc_id", F.size("lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), F.coalesce(_kept(), F.lit("")).alias("kept_text"))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with the same columns and shortened texts; n_chars, if there is one, follows the text.
    A null text stays null."""
    out = marked(docs, min_docs, min_chars)
    out = out.select("d", F.when(F.col("d.text").isNotNull(), F.coalesce(_kept(), F.lit(""))).alias("kept"))
    new = {"text": F.col("kept"), "n_chars": F.coalesce(F.char_length("kept"), F.col("d.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(new[f.name].cast(f.dataType) if new.get(f.name) is not None else F.col(f"d.`{f.name}`")).alias(f.name) for f in docs.schema.fields])
