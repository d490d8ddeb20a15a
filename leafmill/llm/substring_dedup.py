"""Exact substring dedup by level-wise doubling of repeated word windows.

A window of ``window`` consecutive words is a repeat if its words also start anywhere else, in the same
document or another.  Testing every window against the whole corpus would ship one hash a word, so
windows are found from the inside out:

* Level 1 takes short windows of ``ceil(window / 4)`` words, at anchors only: the position with the least
  hash among the first ``window - 2 * base + 1`` of each long window.  Equal long windows have equal
  anchors, so none is missed.  Short windows seen once are dropped.
* Level 2 extends the survivors, and them alone, to twice that length.
* Level 3 extends the survivors to the full length.  All windows with one anchor form a span.  A
  span whose words occur twice is a repeat as a whole; only spans that differ from others around the same
  anchor are taken apart into windows.  This decides which words go.
* From there on lengths double until no candidate survives: windows all of whose parts are repeats are candidates, every
  one of them.  They too are held as spans around anchors, and a span that occurs twice is a repeat as a whole; spans
  that differ are taken apart only where a document could have a longer repeat than is known already.  This
  tells how long the repeats are (``longest_repeat``: the greatest doubled length at which any window of the document repeats,
  0 if nothing does).

Every level is a partial aggregate by hash, so that a passage that stands in a third of all documents
meets as one row a task; the joins back are plain equi-joins that skew handling can split.  Keys are 128 bits
or more: two or three independent 64-bit hashes.

``window`` is 4 to 120 words, so that the windows of one span fit the bits of a number.

Nulls and edge cases: an empty table gives an empty one; a null text has no words; texts shorter than the window lose nothing; a null doc_id
is a document like any other; rows alike in doc_id and text are two documents that repeat each other, however many they are (lists
of a document's spans are sets); of equal hashes at an anchor the leftmost counts; a very long text is cut into spans in time that
grows with its length.
Columns besides ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import BASE_A, BASE_B, PIECE, Poly, mix, raw_text, same_key, slices, stage, text_key, tidy, tokens_of

KEY = ["doc_id", "tk"]
SPAN = ["h9", "h18", "s1"]
_NONE = np.zeros(0, np.int64)
#: Stands behind each text among the hashes of words; windows that hold it are none.
SIGN = np.uint64(0x2545F4914F6CDD1D)


def least_of(values: np.ndarray, size: int) -> np.ndarray:
    """Where the least of each run of ``size`` values stands, the leftmost of equals.  Values are compared by their upper 32 bits, as
    the lower ones hold a place; runs are put together from runs of half their size."""
    n, bits = len(values), np.uint64(32)
    least, width = values >> bits << bits | np.arange(n, dtype=np.uint64), 1
    while 2 * width <= size:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < size:
        least = np.minimum(least[: n - size + 1], least[size - width :][: n - size + 1])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


class Texts:
    """Some texts, a megabyte or one long one: the hashes of their words one after the other, with a sign behind each text."""

    def __init__(self, raws: list[bytes]):
        self.data = b" ".join(raws) + b" "
        self.starts, self.ends, h = tokens_of(self.data)
        self.stops = np.searchsorted(self.starts, np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1))
        self.n = np.diff(np.concatenate(([0], self.stops)))
        self.hashes = np.insert(h, self.stops, SIGN)
        self.doc = np.repeat(np.arange(len(raws)), self.n + 1)
        signs = np.zeros(len(self.hashes), bool)
        signs[np.cumsum(self.n + 1) - 1] = True
        self.signs = signs
        self.before = np.concatenate(([0], np.cumsum(signs)))
        self.a, self.b = Poly(self.hashes, BASE_A), Poly(mix(self.hashes), BASE_B)

    def windows(self, length: int) -> np.ndarray:
        """Where windows of one text begin."""
        return np.flatnonzero(self.before[length:] == self.before[:-length]) if len(self.hashes) >= length else _NONE

    def named(self, doc: np.ndarray, s: np.ndarray) -> np.ndarray:
        """One number for a text and a span."""
        return mix(s.view(np.uint64) + mix(doc.astype(np.uint64) + np.uint64(1)))


def spans_of(t: Texts, window: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, level-1 hash, level-2 hash, span hash) of each span of the texts."""
    starts, base = t.windows(window), -(-window // 4)
    if not len(starts):
        return (_NONE,) * 5
    short = t.a.grams(base)
    anchor = least_of(short, window - 2 * base + 1)[starts]
    cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))))
    count, at, first = np.diff(np.append(cut, len(starts))), anchor[cut], starts[cut]
    whole = mix(t.b.of(first, count + (window - 1)) ^ count.astype(np.uint64))
    return first, count, short[at].view(np.int64), t.a.of(at, 2 * base).view(np.int64), whole.view(np.int64)


def each_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    for batch in batches:
        for a, b in slices(batch.column("raw"), PIECE):
            part = batch.slice(a, b - a)
            yield part, Texts([x.as_py() for x in part.column("raw")])


def _emit_spans(window: int, level1_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in each_piece(batches):
            first, count, h9, h18, s1 = spans_of(t, window)
            if level1_only:
                h, n = np.unique(h9, return_counts=True)
                yield pa.record_batch({"h9": h, "n": n.astype(np.int64)})
                continue
            _, at, n = np.unique(t.named(t.doc[first], s1), return_index=True, return_counts=True)
            doc = pa.array(t.doc[first[at]])
            keys = {k: batch.column(k).take(doc) for k in KEY}
            yield pa.record_batch(keys | {"h9": h9[at], "h18": h18[at], "s1": s1[at], "cnt": count[at].astype(np.int32), "n": n.astype(np.int64)})

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The texts that the items of a column of lists belong to, and the items."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), column.flatten()


def _taken_apart(first: np.ndarray, count: np.ndarray, keep: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(span, place) of every window of the spans to keep, some at a time."""
    which = np.repeat(keep, count[keep])
    place = np.arange(len(which)) - np.repeat(np.cumsum(count[keep]) - count[keep], count[keep])
    for x in range(0, len(which), 400_000):
        yield which[x : x + 400_000], place[x : x + 400_000]


def _emit_windows(window: int):
    """Of each document's named spans: every window, with its place in the span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in each_piece(batches):
            first, count, h9, h18, s1 = spans_of(t, window)
            doc, names = _lists(batch.column("wanted"))
            own = t.named(t.doc[first], s1)
            keep = np.unique(own, return_index=True)[1]
            keep = keep[np.isin(own[keep], t.named(doc, names.to_numpy(zero_copy_only=False).astype(np.int64)))]
            for which, place in _taken_apart(first, count, keep):
                w = t.b.of(first[which] + place, window).view(np.int64)
                yield pa.record_batch({"h9": h9[which], "h18": h18[which], "s1": s1[which], "w": w, "place": place.astype(np.int32)})

    return run


def repeated_starts(t: Texts, window: int, spans: pa.Array) -> np.ndarray:
    """Which windows are repeats, given those of each text's spans as bit masks."""
    out = np.zeros(len(t.hashes), bool)
    doc, items = _lists(spans)
    if not len(items):
        return out
    first, count, _, _, s1 = spans_of(t, window)
    names = t.named(doc, items.field("s1").to_numpy(zero_copy_only=False).astype(np.int64))
    masks = items.field("mask").to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(names)
    names, masks = names[order], masks[order]
    own = t.named(t.doc[first], s1)
    at = np.minimum(np.searchsorted(names, own), len(names) - 1)
    mask = np.where(names[at] == own, masks[at], 0)
    some = np.flatnonzero(mask)
    first, count, mask = first[some], count[some], mask[some]
    for bit in range(int(count.max()) if len(count) else 0):
        out[first[(mask >> bit & 1 == 1) & (bit < count)] + bit] = True
    return out


def covered(repeated: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words stand in a repeated window."""
    mark = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(repeated)
    mark[starts] += 1  # one window a start, so no index repeats
    mark[starts + window] -= 1
    return np.cumsum(mark[:n]) > 0


def candidates(repeated: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, starts) of the windows of window * 2**level words, level >= 1, all of whose parts are repeats."""
    rows = -(-len(repeated) // window)
    grid = np.zeros(rows * window, bool)
    grid[: len(repeated)] = repeated
    chain = np.zeros((rows + 1, window), np.int64)
    for r in range(rows - 1, -1, -1):  # how many repeats follow each other, end to end
        chain[r] = (chain[r + 1] + 1) * grid[r * window : (r + 1) * window]
    parts, level = chain.ravel(), 1
    while len(starts := np.flatnonzero(parts >= 1 << level)):
        yield level, starts
        level += 1


def longer_spans(t: Texts, repeated: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, first window, windows, anchor hash, span hash) of the candidates of each level.  Windows that follow each other
    and have one anchor form a span, as at the levels before; equal windows have equal anchors."""
    for level, starts in candidates(repeated, window):
        length = window << level
        base = -(-length // 4)
        short = t.a.grams(base)
        anchor = least_of(short, length - 2 * base + 1)[starts]
        cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))))
        count, at, first = np.diff(np.append(cut, len(starts))), anchor[cut], starts[cut]
        around = mix(t.a.of(at, 2 * base) ^ mix(short[at] + np.uint64(level)))
        whole = mix(t.b.of(first, count + (length - 1)) ^ (count.astype(np.uint64) << np.uint64(8) | np.uint64(level)))
        yield level, first, count, around.view(np.int64), whole.view(np.int64)


def kept_bytes(t: Texts, bad: np.ndarray) -> list[bytes]:
    """The words of each text that stay, joined by one space."""
    x = np.frombuffer(t.data, np.uint8)
    stay = ~bad[~t.signs]
    # A word that stays is copied with the blank behind it, which becomes a space.
    step = np.zeros(len(x) + 1, np.int8)
    step[t.starts[stay]] = 1
    step[t.ends[stay] + 1] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    out = x[inside]
    size = np.concatenate(([0], np.cumsum(np.where(stay, t.ends - t.starts + 1, 0))))
    out[size[1:][stay] - 1] = 32
    stops = size[np.concatenate(([0], t.stops))].tolist()
    whole = out.tobytes()
    return [whole[a : max(a, b - 1)] for a, b in zip(stops, stops[1:], strict=False)]


def _apply(window: int, with_text: bool):
    """One row a document, and one for each span of longer candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in each_piece(batches):
            repeated, n = repeated_starts(t, window, batch.column("spans")), batch.num_rows
            bad = covered(repeated, len(t.hashes), window)
            kept = kept_bytes(t, bad)
            cols = {k: batch.column(k) for k in KEY} | {"n_words": pa.array(t.n, pa.int64()), "n_removed": pa.array(np.bincount(t.doc, bad, n).astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
            cols["kept_text"] = pa.array(kept, pa.binary()).cast(pa.string()) if with_text else pa.nulls(n, pa.string())
            yield pa.record_batch(cols | {"level": pa.nulls(n, pa.int32()), "a": pa.nulls(n, pa.int64()), "s": pa.nulls(n, pa.int64()), "n": pa.nulls(n, pa.int64())})
            for level, first, _, around, whole in longer_spans(t, repeated, window):
                _, at, seen = np.unique(t.named(t.doc[first], whole), return_index=True, return_counts=True)
                doc, m = pa.array(t.doc[first[at]]), len(at)
                cols = {k: batch.column(k).take(doc) for k in KEY} | {"n_words": pa.nulls(m, pa.int64()), "n_removed": pa.nulls(m, pa.int64()), "kept_sha256": pa.nulls(m, pa.string()), "kept_text": pa.nulls(m, pa.string())}
                yield pa.record_batch(cols | {"level": np.full(m, level, np.int32), "a": around[at], "s": whole[at], "n": seen.astype(np.int64)})

    return run


def _emit_longer(window: int):
    """Of each document's named spans of longer candidates: every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in each_piece(batches):
            doc, names = _lists(batch.column("wanted"))
            wanted = t.named(doc, names.to_numpy(zero_copy_only=False).astype(np.int64))
            for level, first, count, _, whole in longer_spans(t, repeated_starts(t, window, batch.column("spans")), window):
                own = t.named(t.doc[first], whole)
                keep = np.unique(own, return_index=True)[1]
                keep = keep[np.isin(own[keep], wanted)]
                for which, place in _taken_apart(first, count, keep):
                    w = t.b.of(first[which] + place, window << level).view(np.int64)
                    yield pa.record_batch({"level": np.full(len(w), level, np.int32), "s": whole[which], "w": w})

    return run


def longest_repeats(rows: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """rows of _apply, texts (KEY, raw, spans) -> (KEY, longest) of documents in which a window of twice the length or more repeats.

    A span that occurs twice is a repeat.  For a document the question is then whether it has one at a level above its longest so far:
    only spans around the anchors of such rows, and only where they differ, are taken apart into windows."""
    at = ["level", "s"]
    found = stage(rows.where("level is not null").select(*KEY, F.xxhash64(*KEY).alias("dk"), "level", "a", "s", "n"))
    spans = stage(found.groupBy("level", "a", "s").agg(F.sum("n").alias("n"), F.min("dk").alias("dk")))
    twice = spans.where("n >= 2").select(*at)
    sure = stage(stage(_joined(found.select(*KEY, "dk", *at), twice, at)).groupBy(*KEY, "dk").agg(F.max("level").alias("sure")))
    above = stage(found.join(sure.select("dk", "sure"), "dk", "left").where("level > coalesce(sure, 0)").select(*KEY, "dk", "level", "a", "s"))
    mixed = stage(above.select("level", "a").distinct().join(spans.groupBy("level", "a").agg(F.count("*").alias("k")).where("k >= 2").drop("k"), ["level", "a"], "left_semi"))
    apart = stage(_joined(spans.select("level", "a", "s", "dk"), mixed, ["level", "a"]).select(*at, "dk"))
    wanted = stage(_joined(found.select(*KEY, *at, "dk"), apart, [*at, "dk"]).select(*KEY, "s")).groupBy(*KEY).agg(F.collect_set("s").alias("wanted"))
    sources = texts.join(wanted, same_key(texts, wanted, KEY)).select(*[texts[k] for k in KEY], texts["raw"], texts["spans"], wanted["wanted"])
    once = sources.dropDuplicates(KEY).drop(*KEY)  # rows alike in both hold the same windows
    windows = stage(once.mapInArrow(tidy(_emit_longer(window)), "level int, s long, w long"))
    shared = stage(windows.groupBy("level", "w").agg(F.min("s").alias("x"), F.max("s").alias("y")).where("x <> y").select("level", "w"))
    part = stage(_joined(windows, shared, ["level", "w"]).select(*at).distinct())
    more = stage(_joined(above.select(*KEY, *at), part, at)).groupBy(*KEY).agg(F.max("level").alias("sure"))
    both = sure.select(*KEY, "sure").unionByName(more).groupBy(*KEY).agg(F.max("sure").alias("level"))
    return both.select(*KEY, F.expr(f"{window}L * shiftleft(1L, level)").alias("longest"))


def _joined(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    return a.join(b, names)


def repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, tk, spans): for each document that has any, its spans with repeats and their masks."""
    if not 4 <= window <= 120:
        raise ValueError("window must be 4 to 120 words")  # so that a span's windows fit a 64-bit mask
    base = docs.select("doc_id", text_key().alias("tk"), raw_text().alias("raw"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    full_schema = f"doc_id {id_type}, tk long, h9 long, h18 long, s1 long, cnt int, n long"

    # Level 1: short windows at anchors.
    level1 = base.select("raw").mapInArrow(tidy(_emit_spans(window, True)), "h9 long, n long")
    twice = stage(level1.groupBy("h9").agg(F.sum("n").alias("n")).where("n >= 2").select("h9"))
    rows = base.mapInArrow(tidy(_emit_spans(window, False)), full_schema)
    alive = stage(_joined(rows, twice, ["h9"]).withColumn("dk", F.xxhash64("doc_id", "tk")))

    # Level 2: the survivors, twice as long.
    twice = stage(alive.groupBy("h9", "h18").agg(F.sum("n").alias("n")).where("n >= 2").select("h9", "h18"))

    # Last level: whole spans, then the windows of spans that share an anchor but differ.
    spans = stage(_joined(alive, twice, ["h9", "h18"]).groupBy(*SPAN, "cnt").agg(F.sum("n").alias("n"), F.min("dk").alias("dk")))
    mixed = stage(spans.groupBy("h9", "h18").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k >= 2 and least < 2").select("h9", "h18"))
    apart = stage(_joined(spans, mixed, ["h9", "h18"]).select(*SPAN, "dk"))
    wanted = _joined(alive.select(*KEY, *SPAN, "dk"), apart, [*SPAN, "dk"]).groupBy(*KEY).agg(F.collect_set("s1").alias("wanted"))
    sources = base.join(wanted, same_key(base, wanted, KEY)).select(base["raw"], wanted["wanted"])
    windows = stage(sources.mapInArrow(tidy(_emit_windows(window)), "h9 long, h18 long, s1 long, w long, place int"))
    shared = stage(windows.groupBy("h9", "h18", "w").agg(F.min("s1").alias("a"), F.max("s1").alias("b")).where("a <> b").select("h9", "h18", "w"))
    part = _joined(windows, shared, ["h9", "h18", "w"]).select(*SPAN, F.expr("shiftleft(1L, place)").alias("mask"))
    whole = spans.where("n >= 2").select(*SPAN, F.expr("shiftleft(1L, cnt) - 1L").alias("mask"))
    masks = stage(whole.unionByName(part).groupBy(*SPAN).agg(F.bit_or("mask").alias("mask")))
    return _joined(alive.select(*KEY, *SPAN), masks, SPAN).groupBy(*KEY).agg(F.collect_set(F.struct("s1", "mask")).alias("spans"))


def substring_dedup(docs: DataFrame, window: int = 35, with_text: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, longest_repeat and, if asked for, kept_text (the
    words that stay, joined by one space)."""
    found = stage(repeated_spans(docs.select("doc_id", "text"), window))
    base = docs.select("doc_id", text_key().alias("tk"), raw_text().alias("raw"))
    both = base.join(found, same_key(base, found, KEY), "left").select(base["doc_id"], base["tk"], base["raw"], found["spans"])
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = stage(both.mapInArrow(tidy(_apply(window, with_text)), f"doc_id {id_type}, tk long, n_words long, n_removed long, kept_sha256 string, kept_text string, level int, a long, s long, n long"))
    own, longest = rows.where("level is null"), longest_repeats(rows, both.where("spans is not null"), window)
    out = own.join(longest, same_key(own, longest, KEY), "left")
    least = F.when(own["n_removed"] > 0, window).otherwise(0).cast("long")
    cols = [own["doc_id"], own["n_words"], own["n_removed"], own["kept_sha256"], F.coalesce(longest["longest"], least).alias("longest_repeat")]
    return out.select(*cols, *([own["kept_text"]] if with_text else []))
