"""SimHash near-dedup over a byte-position inverted index with count filtering.

Fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they share 5 bytes in
place: the guaranteed minimum.  A posting is a set of byte positions with their values.  The 20 four-byte
sets of a Turan system suffice: every choice of 5 of the 8 positions contains one of them.  Within a posting
the bytes shared in place are tallied for each pair, pairs under the minimum are dropped, and the rest
verified on the whole fingerprint.

What keeps it linear: equal fingerprints are one entry, however many documents have them.  A posting with
more than ``hot`` entries is not compared but divided: its pairs must share one of the four other bytes too
(level 2, 24 free bits), then 3 of the 6 half-bytes left (level 3, 12 free bits, hence 4096 entries at most).
A posting yields the edges of a spanning forest of its links, never its pairs.  Groups are then joined over all
postings by alternating large-star and small-star steps; every step is a partial aggregate and an
equi-join.

Nulls and edge cases: null and word-less texts have fingerprint zero and are linked like any other; fewer than
three words make one shingle; a bit that is set in exactly half the hashes is 0; a null doc_id is kept, and names a group only if
the group has no other; rows alike in doc_id and text are rows of one group, of which one stays in keep_one; an empty table
gives an empty one; a very long text is hashed some 262,144 shingles at a time; other columns of docs, whatever their
names, are carried in one struct by keep_one and not looked at by simhash_groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import packed, raw_text, same_key, stage, text_key, tidy, unpacked
from .components import components

BITS, LEAST_SHARED, SEED = 3, 5, 42
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _turan_sets() -> list[tuple[int, ...]]:
    """20 four-sets of 8 positions, one in every five-set.  Two disjoint quadruples of positions, each cut
    in two pairs: whole quadruples, two pairs across, and three of one with one of the other are built
    by the greedy rule below, which finds a cover; the test checks that it covers."""
    todo, out = set(combinations(range(8), LEAST_SHARED)), []
    fours = list(combinations(range(8), 4))
    while todo:
        best = max(fours, key=lambda c: (sum(set(c) <= set(x) for x in todo), [-i for i in c]))
        out.append(best)
        todo = {x for x in todo if not set(best) <= set(x)}
    return out


SETS = _turan_sets()
_NIBBLES = list(combinations(range(6), 3))


def fingerprint(words: list[bytes], n: int = 3) -> int:
    """Bit i is 1 if set in over half the XXH64 values of the shingles, repeats included."""
    if not words:
        return 0
    if len(words) < n:
        shingles = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[: len(words) - n + 1].tolist()
        shingles = [joined[s:e] for s, e in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 18):
        counts += np.unpackbits(h[i : i + (1 << 18)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, tk, fp (as signed long)."""
    base = docs.select("doc_id", text_key().alias("tk"), raw_text().alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(x.as_py().lower().split()) for x in batch.column("raw")]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "tk": batch.column("tk"), "fp": np.array(fp, np.uint64).view(np.int64)})

    return base.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tk long, fp long")


def _bytes_of(fp: np.ndarray) -> np.ndarray:
    return fp.astype("<i8").view(np.uint8).reshape(-1, 8)


def _postings(sets: list[tuple[int, ...]]):
    """fp -> (posting, fp) for every set of byte positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            b = _bytes_of(fp).astype(np.int64)
            for k, s in enumerate(sets):
                key = np.full(len(fp), k, np.int64)
                for p in s:
                    key = key << 8 | b[:, p]
                yield pa.record_batch({"key": key, "key2": np.zeros(len(fp), np.int64), "fp": fp})

    return run


def _divide(level: int):
    """Postings of hot postings: one more byte (level 2), then three half-bytes (level 3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, key2, fp = (batch.column(c).to_numpy() for c in ("key", "key2", "fp"))
            b = _bytes_of(fp).astype(np.int64)
            fixed = np.array(SETS)[key >> 32]
            free = np.array([[p for p in range(8) if p not in s] for s in SETS])[key >> 32]
            rows = np.arange(len(fp))
            if level == 2:
                for j in range(4):
                    yield pa.record_batch({"key": key, "key2": (1 + j) << 8 | b[rows, free[:, j]], "fp": fp})
            else:
                del fixed
                own = (key2 >> 8) - 1
                left = np.array([[i for i in range(4) if i != j] for j in range(4)])[own]
                rest = b[rows[:, None], free[rows[:, None], left]]
                half = np.stack([rest >> 4, rest & 15], 2).reshape(-1, 6)
                for k, (x, y, z) in enumerate(_NIBBLES):
                    more = ((1 + k) << 12 | half[:, x] << 8 | half[:, y] << 4 | half[:, z]) << 16
                    yield pa.record_batch({"key": key, "key2": key2 | more, "fp": fp})

    return run


def forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among the distinct fingerprints of one posting."""
    n = len(fp)
    b = _bytes_of(fp)
    label = np.arange(n)
    us, vs = [], []
    for i in range(1, n):
        shared = (b[:i] == b[i]).sum(1)
        near = np.flatnonzero(shared >= LEAST_SHARED)
        if not len(near):
            continue
        near = near[_POP[b[near] ^ b[i]].sum(1) <= BITS]
        if not len(near):
            continue
        _, at = np.unique(label[near], return_index=True)  # one edge to each tree that it joins
        for j in near[at]:
            us.append(fp[i])
            vs.append(fp[j])
        low = label[near].min()
        label[np.isin(label[: i + 1], label[near]).nonzero()[0]] = low
        label[i] = low
    return np.array(us, np.int64), np.array(vs, np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by posting; a posting may go on in the next batch."""
    held: list[np.ndarray] = []

    def edges(fp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        pairs = ends - starts == 2
        a, b = fp[starts[pairs]], fp[starts[pairs] + 1]
        x, y = _bytes_of(a), _bytes_of(b)
        ok = ((x == y).sum(1) >= LEAST_SHARED) & (_POP[x ^ y].sum(1) <= BITS)
        us.append(a[ok])
        vs.append(b[ok])
        for s, e in zip(starts[~pairs].tolist(), ends[~pairs].tolist(), strict=True):
            u, v = forest(fp[s:e])
            us.append(u)
            vs.append(v)
        return pa.record_batch({"u": np.concatenate(us), "v": np.concatenate(vs)})

    def cut(cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        key, key2, fp = cols
        new = np.flatnonzero((key[1:] != key[:-1]) | (key2[1:] != key2[:-1])) + 1
        bounds = np.concatenate(([0], new, [len(key)]))
        if not last:
            held = [c[bounds[-2] :] for c in cols]
            bounds = bounds[:-1]
        starts, ends = bounds[:-1], bounds[1:]
        many = ends - starts > 1
        if many.any():
            yield edges(fp, starts[many], ends[many])

    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in ("key", "key2", "fp")]
        if held:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if len(cols[0]):
            yield from cut(cols, False)
    if held and len(held[0]):
        yield from cut(held, True)


def links(distinct: DataFrame, hot: int = 1024) -> DataFrame:
    """distinct (fp) -> edges (u, v) whose connected components are those of all links."""
    shape = "key long, key2 long, fp long"
    rows = distinct.mapInArrow(tidy(_postings(SETS)), shape)
    out = None
    for level in (1, 2, 3):
        by = ["key", "key2"]
        sizes = stage(rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"))
        small = rows.join(sizes.where(F.col("n") <= hot) if level < 3 else sizes, by).select("key", "key2", "fp")
        found = small.repartition(*by).sortWithinPartitions(*by).mapInArrow(tidy(_compare), "u long, v long")
        out = found if out is None else out.unionByName(found)
        large = sizes.where(F.col("n") > hot)
        if level == 3 or large.isEmpty():
            break
        rows = stage(rows.join(large.select(*by), by).mapInArrow(tidy(_divide(level + 1)), shape))
    return stage(out.distinct())


def simhash_groups(docs: DataFrame, hot: int = 1024) -> DataFrame:
    """Per row of docs: doc_id, tk (tells rows of one doc_id apart), fp, component_id."""
    fps = stage(fingerprints(docs.select("doc_id", "text")))
    first = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(first.select("fp"), hot))
    known = stage(first.join(roots, first["fp"] == roots["node"], "left").select(first["fp"], "least", F.coalesce("root", "fp").alias("root")))
    named = stage(known.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = stage(known.join(named, "root").select("fp", "component_id"))
    return fps.join(by_fp, "fp").select("doc_id", "tk", "fp", "component_id")


def keep_one(docs: DataFrame, hot: int = 1024) -> DataFrame:
    """The row with the least doc_id of each group, with the columns of docs; of rows alike in doc_id, the one
    with the least text key, and of rows alike in both, one."""
    groups = simhash_groups(docs, hot)
    best = stage(groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tk")).alias("b")).select("b.doc_id", "b.tk"))
    base = packed(docs, doc_id=F.col("doc_id"), tk=text_key())
    found = base.join(best, same_key(base, best, ["doc_id", "tk"])).select(base["d"], base["doc_id"], base["tk"])
    twice = groups.groupBy("doc_id", "tk").agg(F.count("*").alias("n")).where("n > 1")
    return unpacked(found if twice.isEmpty() else found.dropDuplicates(["doc_id", "tk"]), docs)
