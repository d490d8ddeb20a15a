import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import DOCS, rows, rows_of, table

from leafmill.llm.substring_dedup import Texts, kept_bytes, least_of, spans_of, substring_dedup


def brute(data, n):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in data]
    seen = Counter(tuple(w[i : i + n]) for w in texts for i in range(len(w) - n + 1))
    out = []
    for (doc_id, *_), w in zip(data, texts, strict=True):
        bad = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                bad |= set(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in bad)
        out.append((doc_id, len(w), len(bad), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [35, 8])
def test_equals_brute_force(spark, window):
    data = rows()
    got = substring_dedup(table(spark, extra=True), window, with_text=False)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute(data, window)


def test_shared_edges(spark):
    """Windows that overlap at both sides of an edit, and repeats inside one text only."""
    a = [f"a{i}" for i in range(120)]
    b = [*a[:50], "X", *a[51:]]
    c = [f"c{i}" for i in range(40)]
    data = [(1, " ".join(a), "", "", 1), (2, " ".join(b), "", "", 1), (3, " ".join(c + ["mid"] + c), "", "", 1), (4, " ".join(a[10:45]), "", "", 1), (5, " ".join(a[10:44]), "", "", 1), (6, "p q " * 50, "", "", 1)]
    assert rows_of(substring_dedup(table(spark, data), 35), "doc_id", "n_words", "n_removed", "kept_sha256") == brute(data, 35)


def longest(data, n):
    """Over all windows of each doubled length."""
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in data]
    out, size, any_left = [0] * len(data), n, True
    while any_left:
        seen = Counter(tuple(w[i : i + size]) for w in texts for i in range(len(w) - size + 1))
        again = [k for k, w in enumerate(texts) if any(seen[tuple(w[i : i + size])] > 1 for i in range(len(w) - size + 1))]
        for k in again:
            out[k] = size
        size, any_left = size * 2, bool(again)
    return sorted(((d, x) for (d, *_), x in zip(data, out, strict=True)), key=repr)


def test_least_of():
    rng = np.random.default_rng(1)
    for n, size in ((1, 1), (50, 7), (49, 7), (300, 18), (20, 20), (64, 16)):
        v = rng.integers(0, 9, n).astype(np.uint64) << np.uint64(40)
        assert least_of(v, size).tolist() == [i + int(np.argmin(v[i : i + size])) for i in range(n - size + 1)]


def test_kept_bytes():
    t = Texts([b" a  bc\n", b"", b"d", b"x y\tz"])
    bad = np.zeros(len(t.hashes), bool)
    assert kept_bytes(t, bad) == [b"a bc", b"", b"d", b"x y z"]
    bad[[0, 4, 7]] = True  # a, d, y
    assert kept_bytes(t, bad) == [b"bc", b"", b"", b"x z"]


@pytest.mark.parametrize("window", [35, 8])
def test_lengths_double_until_none_survives(spark, window):
    data = rows()
    got = rows_of(substring_dedup(table(spark), window, with_text=False), "doc_id", "longest_repeat")
    assert got == longest(data, window) and max(x for _, x in got) > 2 * window


def test_longest_among_passages_that_overlap(spark):
    """Passages cut out of one text here and there: spans differ at their edges, so windows decide."""
    rng = random.Random(11)
    source = [f"s{i}" for i in range(400)]
    data = []
    for k in range(40):
        a = rng.randrange(300)
        middle = source[a : a + rng.randrange(30, 200)]
        data.append((k, " ".join([f"b{k}", *middle, f"e{k}"]), "", "", 1))
    got = rows_of(substring_dedup(table(spark, data), 8, with_text=False), "doc_id", "n_removed", "longest_repeat")
    removed = {r[0]: r[2] for r in brute(data, 8)}
    assert got == sorted(((d, removed[d], x) for d, x in longest(data, 8)), key=repr) and len({x for *_, x in got}) > 2


def test_many_equal_rows(spark):
    """Rows alike in doc_id and text: each is a document of its own, and no list grows with them."""
    text = " ".join(f"r{i}" for i in range(150))
    data = [(None, text, "", "", 1)] * 3000 + [(1, text + " end", "", "", 1), (2, "own words only", "", "", 1)]
    got = rows_of(substring_dedup(table(spark, data), 35, with_text=False), "doc_id", "n_words", "n_removed", "longest_repeat")
    assert got == sorted([(None, 150, 150, 140)] * 3000 + [(1, 151, 150, 140), (2, 3, 0, 0)], key=repr)


def test_empty_table_and_text_column(spark):
    assert substring_dedup(spark.createDataFrame([], DOCS)).collect() == []
    got = substring_dedup(table(spark, [(1, "a  b\nc", "", "", 1), (2, None, "", "", 1)])).orderBy("doc_id").collect()
    assert [r["kept_text"] for r in got] == ["a b c", ""]
    with pytest.raises(ValueError):
        substring_dedup(table(spark), 3)


def test_spans_cover_every_window_once():
    """Of each text, none across two, and a text alone has the spans that it has among others."""
    texts = [b" ".join(b"x%d" % (i * i % 17 + k) for i in range(n)) for k, n in enumerate((200, 34, 35, 90))]
    t = Texts(texts)
    first, count, *names = spans_of(t, 35)
    begins = np.cumsum(t.n + 1) - (t.n + 1)
    want = np.concatenate([b + np.arange(max(n - 34, 0)) for b, n in zip(begins, t.n, strict=True)])
    assert np.array_equal(np.concatenate([np.arange(f, f + c) for f, c in zip(first, count, strict=True)]), want) and count.max() <= 18
    for k, text in enumerate(texts):
        alone = spans_of(Texts([text]), 35)
        at = t.doc[first] == k
        assert np.array_equal(first[at] - begins[k], alone[0]) and all(np.array_equal(x[at], y) for x, y in zip(names, alone[2:], strict=True))


def test_longest_repeat_of_all_windows(spark):
    """Passages of 70 words and more reach the doubled length wherever they begin, counted over all windows."""
    rng = random.Random(7)
    data = []
    for k in range(24):
        passage = [f"p{k}.{i}" for i in range(rng.choice([35, 60, 69, 70, 71, 80, 100, 139, 140, 150]))]
        for copy in range(2):
            before, after = ([f"{side}{k}.{copy}.{i}" for i in range(rng.randrange(40))] for side in "ba")
            data.append((2 * k + copy, " ".join([*before, *passage, *after]), "", "", 1))
    want = {d: 0 for d, *_ in data}
    for size in (35, 70, 140):
        seen = Counter(tuple(w[i : i + size]) for _, t, *_ in data for w in [t.split()] for i in range(len(w) - size + 1))
        for d, t, *_ in data:
            w = t.split()
            if any(seen[tuple(w[i : i + size])] > 1 for i in range(len(w) - size + 1)):
                want[d] = size
    got = {r["doc_id"]: r["longest_repeat"] for r in substring_dedup(table(spark, data), 35, with_text=False).collect()}
    assert got == want and set(want.values()) == {35, 70, 140}
