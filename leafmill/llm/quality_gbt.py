"""Quality rules: document statistics, hard rules, and gradient-boosted trees kept as flat numpy arrays.

The statistics of every whole text are computed once, in Arrow batches.  The trees are fitted on the driver on a
bounded sample of the labelled rows (``max_train_rows``, the rows with the least hash of their id), which is the
one bound here; statistics, rules and scores cover all rows.  Chosen features are monotone: a split that would
break the order is refused, and the midpoint of a split bounds the leaves below it.

Nulls and edge cases: a null or empty text has no words, fails the base rules and gets all-zero
statistics; labels without a document, null labels and repeated rows are harmless (null labels are ignored, of several labels of
an id the least counts, and of several documents with one id the trees see the one with the least statistics);
an empty table gives an empty one; a very long text is one row like any other; a probability just at the bound is
kept; columns of docs besides doc_id and text may have any names: those asked for by ``keep`` come back as they are;
with fewer than two classes among the labels the trees keep everything and the hard rules decide alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import BASE_A, Poly, packed, raw_text, stage, tidy, unpacked, word_hashes

_SYMBOL = re.compile(rb"[#*$%&|<>]")
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Feature -> sign of its effect on quality: 1 never lowers it, -1 never raises it, 0 free.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1,
    "upper_rate": -1, "digit_rate": 0, "punct_end_rate": -1, "short_line_rate": 0, "distinct_rate": 0, "bang_rate": -1, "word_spread": 0,
}
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


def repeat_words(hashes: np.ndarray, n: int = 5) -> int:
    """Words in n-word windows that stand twice or more in the text, the first included."""
    if len(hashes) <= n:
        return 0
    grams = Poly(hashes, BASE_A).grams(n)
    _, inverse, count = np.unique(grams, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[inverse] > 1)
    if not len(starts):
        return 0
    mark = np.zeros(len(hashes) + 1, np.int64)
    mark[starts] += 1
    mark[starts + n] -= 1
    return int((np.cumsum(mark[:-1]) > 0).sum())


def statistics(raw: bytes) -> tuple[list[int], list[float]]:
    """The base counts in the order of _BASE, and the features in that of FEATURES."""
    words = raw.split()
    n = len(words)
    seen: set[bytes] = set()
    dup = lines = short = ends = 0
    for line in raw.split(b"\n"):
        bare = line.strip()
        if bare:
            lines += 1
            short += len(bare) < 40
            ends += bare[-1:] not in b".!?:\"'"
            if line in seen:
                dup += 1
            seen.add(line)
    data = np.frombuffer(raw, np.uint8)
    hist = np.bincount(data, minlength=256)
    inner = int(hist[0x80:0xC0].sum())
    spaces = int(hist[9:14].sum() + hist[32])
    chars = len(raw) - inner - spaces
    symbols = int(hist[list(b"#*$%&|<>")].sum())
    repeated = repeat_words(word_hashes(words))
    lengths = np.fromiter(map(len, words), np.float64, n)
    m, c = max(n, 1), max(chars, 1)
    odd = int(hist[list(b"!?")].sum())
    features = [
        np.log1p(n), chars / m, symbols / c, dup / max(lines, 1), repeated / m, int(hist[65:91].sum()) / c, int(hist[48:58].sum()) / c,
        ends / max(lines, 1), short / max(lines, 1), len(set(words)) / m, odd / c, float(lengths.std()) if n else 0.0,
    ]
    return [n, chars, symbols, dup, repeated], [float(x) for x in features]


def statistics_table(docs: DataFrame, *keep: str) -> DataFrame:
    """keep columns, base counts and features, a row for a row."""
    cols = list(dict.fromkeys(["doc_id", *keep]))
    base = docs.select(*cols, raw_text().alias("raw bytes"))
    names = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [statistics(x.as_py()) for x in batch.column("raw bytes")]
            out = {c: batch.column(c) for c in cols}
            for i, c in enumerate(_BASE):
                out[c] = pa.array([g[0][i] for g in got], pa.int64())
            out["f"] = pa.array([g[1] for g in got], pa.list_(pa.float64()))
            yield pa.record_batch(out)

    return base.mapInArrow(tidy(run), f"{names}, {', '.join(f'{c} long' for c in _BASE)}, f array<double>")


@dataclass
class Trees:
    """All trees in one set of arrays: node i asks f[feature[i]] <= cut[i]; leaves point to themselves."""

    base: float
    root: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    depth: int = 0

    def add(self, feature: int = 0, cut: float = np.inf, value: float = 0.0) -> int:
        i = len(self.feature)
        self.feature.append(feature)
        self.cut.append(cut)
        self.left.append(i)
        self.right.append(i)
        self.value.append(value)
        return i

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of quality 1: every tree of every row at once, one gather a level."""
        feature, cut, left, right, value = (np.array(a) for a in (self.feature, self.cut, self.left, self.right, self.value))
        if not self.root:
            return np.full(len(x), self.base)
        at = np.tile(np.array(self.root), (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, feature[at]] <= cut[at], left[at], right[at])
        return self.base + value[at].sum(1)


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Histogram boosting on logistic loss.  Rows must come in a fixed order."""
    p = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
    model = Trees(base=float(np.log(p / (1 - p))), depth=depth)
    if len(np.unique(y)) < 2:
        return Trees(base=10.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    logit = np.full(len(y), model.base)
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-logit))
        g, h = y - prob, prob * (1 - prob)
        step = np.zeros(len(y))

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()  # noqa: B023
            leaf = float(np.clip(gs / (hs + ridge), low, high))
            best = (1e-6, None)
            if level < depth and len(rows) >= 20:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]  # noqa: B023
                    hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]  # noqa: B023
                    gr, hr = gs - gl, hs - hl
                    vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
                    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs**2 / (hs + ridge)
                    ok = (hl >= least) & (hr >= least) & ((vr - vl) * signs[j] >= 0)
                    if ok.any():
                        k = int(np.argmax(np.where(ok, gain, -np.inf)))
                        if gain[k] > best[0]:
                            best = (float(gain[k]), (j, k, float(vl[k]), float(vr[k])))
            if best[1] is None:
                step[rows] = rate * leaf  # noqa: B023
                return model.add(value=rate * leaf)
            j, k, vl, vr = best[1]
            node, go, mid = model.add(j, float(cuts[j][k])), binned[rows, j] <= k, (vl + vr) / 2
            s = signs[j]
            model.left[node] = grow(rows[go], level + 1, max(low, mid) if s < 0 else low, min(high, mid) if s > 0 else high)
            model.right[node] = grow(rows[~go], level + 1, max(low, mid) if s > 0 else low, min(high, mid) if s < 0 else high)
            return node

        model.root.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        logit += step
    return model


def some_labels(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, y): at most ``most`` labelled documents, those with the least hash of their id.  The hash is cut
    at a share first, so that what any task sends on is about ``most`` rows in all.  A document's label is the least of
    its labels' qualities."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    share = min(1.0, 1.1 * most / max(known.count(), 1))
    near = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    return near.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)), "doc_id").limit(most)


def train(stats: DataFrame, picked: DataFrame, trees: int = 40) -> Trees:
    """stats from statistics_table, picked from some_labels."""
    one = stats.join(picked, "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("f").alias("f"))  # of rows with one id the least
    rows = sorted(one.collect(), key=lambda r: (r["doc_id"], r["f"]))
    x = np.array([r["f"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([float(r["y"] > 0) for r in rows]), list(FEATURES.values()), trees=trees)


def judged(stats: DataFrame, model: Trees, least_prob: float) -> DataFrame:
    """stats (with any further columns, f last used) plus base_failed, quality and kept."""
    cut = float(np.log(least_prob / (1 - least_prob)))
    names = [f.name for f in stats.schema.fields if f.name != "f"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields if f.name != "f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("f")
            x = f.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            n, r = (batch.column(c).to_numpy() for c in ("n_words", "n_repeat_words"))
            failed = (n < 10) | (100 * r > 20 * n)
            score = model.score(x)
            yield pa.record_batch({c: batch.column(c) for c in names} | {"base_failed": failed, "quality": 1 / (1 + np.exp(-score)), "kept": ~failed & (score >= cut)})

    return stats.mapInArrow(tidy(run), f"{schema}, base_failed boolean, quality double, kept boolean")


def quality_rules(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000, least_prob: float = 0.3, trees: int = 40, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, keep columns, base counts, base_failed, quality (probability), kept."""
    stats = stage(statistics_table(docs, *keep))
    return judged(stats, train(stats, some_labels(labels, max_train_rows), trees), least_prob)


def apply_rules(docs: DataFrame, model: Trees, least_prob: float) -> DataFrame:
    """The rows of docs that are kept, with its columns; no shuffle: texts are scored where they are read."""
    cut = float(np.log(least_prob / (1 - least_prob)))
    base = packed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("d").field("text").cast(pa.binary())
            got = [statistics(x.as_py() or b"") for x in texts]
            score = model.score(np.array([g[1] for g in got]).reshape(len(got), len(FEATURES)))
            ok = [not (g[0][0] < 10 or 100 * g[0][4] > 20 * g[0][0]) and s >= cut for g, s in zip(got, score.tolist(), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return unpacked(base.mapInArrow(tidy(run), base.schema), docs)


def keep_good(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000, least_prob: float = 0.3, trees: int = 40) -> DataFrame:
    """docs without what the rules reject, with the same columns.  The trees see the statistics of labelled
    rows only, so the first of the two passes sends few rows."""
    picked = some_labels(labels, max_train_rows)
    stats = stage(statistics_table(docs.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")))  # at most max_train_rows ids
    return apply_rules(docs, train(stats, picked, trees), least_prob)
