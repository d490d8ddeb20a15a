import math
import random
import re
from collections import Counter

import numpy as np
from helpers import DOCS, rows, rows_of, table

from leafmill.llm.quality_gbt import FEATURES, Trees, fit, keep_good, quality_rules, some_labels, statistics, statistics_table, train


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 10 or 100 * r > 20 * n


def labels(spark, data):
    return spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(data)] + [(1, None, 0), (None, 1, 0), (99999, 0, 1)], "doc_id long, quality int, toxic int")


def test_base_counts_equal_brute_force(spark):
    data = rows()
    got = quality_rules(table(spark, extra=True), labels(spark, data), keep=("tk",))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows_of(got, *cols) == sorted(((r[0], *brute(r[1])) for r in data), key=repr)
    assert all(not (r["base_failed"] and r["kept"]) for r in got.collect())


def test_repeat_words_random():
    rng = random.Random(3)
    for _ in range(200):
        t = "".join(rng.choice(["a ", "b ", "c ", "a\n", "É! ", "#"]) for _ in range(rng.randrange(60)))
        assert tuple(statistics(t.encode())[0]) == brute(t)[:5]


def test_trees_learn_hold_order_and_score_flat():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(3000, len(FEATURES)))
    y = ((x[:, 2] < 0.4) & (x[:, 0] > 0.2)).astype(float)
    model = fit(x[:2000], y[:2000], list(FEATURES.values()))
    assert ((model.score(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.97
    for j, sign in enumerate(FEATURES.values()):
        if sign:
            lows, highs = x[:300].copy(), x[:300].copy()
            lows[:, j], highs[:, j] = 0.1, 0.9
            assert (sign * (model.score(highs) - model.score(lows)) >= -1e-12).all()

    def walk(row):
        total = model.base
        for node in model.root:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.cut[node] else model.right[node]
            total += model.value[node]
        return total

    assert np.allclose(model.score(x[:50]), [walk(r) for r in x[:50]])
    assert (fit(x, np.ones(3000), list(FEATURES.values())).score(x) > 5).all() and Trees(base=1.0).score(x[:2]).tolist() == [1.0, 1.0]


def test_quality_and_kept_equal_a_plain_scorer(spark):
    """Node by node, document by document; and ids repeated beyond the bound on labelled rows give one model in any order of rows."""
    data = [*rows(n=80), *[(5, f"copy {i} of an id that many rows share, each with words of its own " * (1 + i % 3), "en", "s", 1) for i in range(60)]]
    df, ls = table(spark, data), labels(spark, data)
    stats = statistics_table(df)
    model = train(stats, some_labels(ls, 30))
    assert len(model.root) > 0

    def walk(f):
        total = model.base
        for node in model.root:
            while model.left[node] != node:
                node = model.left[node] if f[model.feature[node]] <= model.cut[node] else model.right[node]
            total += model.value[node]
        return 1 / (1 + math.exp(-total))

    want = sorted(((r["doc_id"], r["n_words"], round(walk(r["f"]), 9)) for r in stats.collect()), key=repr)
    for parts in (1, 5):
        out = quality_rules(df.repartition(parts), ls, max_train_rows=30)
        got = out.collect()
        assert sorted(((r["doc_id"], r["n_words"], round(r["quality"], 9)) for r in got), key=repr) == want
        assert all(r["kept"] == (not r["base_failed"] and r["quality"] >= 0.3) for r in got)


def test_pipeline_form_agrees_and_empty_tables(spark):
    data = rows()
    df, ls = table(spark, extra=True), labels(spark, data)
    kept = quality_rules(df, ls).where("kept")
    out = keep_good(df, ls)
    assert out.columns == df.columns and rows_of(out, "doc_id") == rows_of(kept, "doc_id")
    empty = spark.createDataFrame([], DOCS)
    assert keep_good(empty, ls).count() == 0 and quality_rules(empty, ls).count() == 0
    assert quality_rules(df, ls.limit(0)).where("not base_failed and not kept").count() == 0
