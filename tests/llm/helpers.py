"""Small tables with the awkward rows that every operator must bear."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=60):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def rows(seed=0, n=40):
    """Random texts, copies, near copies, shared passages, repeats, nulls, empties, ties, one long text."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randrange(5, 160))) for _ in range(n)]
    passage = " ".join(words(rng, 60, 500))
    out = []
    for i, t in enumerate(texts):
        if i % 4 == 1:
            t = texts[i - 1]
        elif i % 4 == 2:
            t = f"{t}\n{passage} tail{i}"
        elif i % 8 == 3:
            w = texts[i - 1].split()
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        out.append((i, t, ["en", "de", None][i % 3], f"src{i % 5}", len(t)))
    line = "Shared  Line\tof boilerplate "
    out += [(100 + i, f"{line}{' ' * (i % 3)}\nown text {i} É\n\n{line.upper()}", "fr", "src0", 1) for i in range(12)]
    out += [(200, None, None, None, None), (201, "", "en", "src1", 0), (202, " \n\t\n", "en", "src1", 4), (203, "x", "en", "src1", 1), (204, "x", "en", "src1", 1)]
    out += [(205, "spam " * 300, "en", "src2", 1500), (206, " ".join(words(rng, 6000, 3000)), "en", "src0", 1), (None, "no id at all here " * 4, "en", "src3", 1)]
    out += [(207, texts[0], "en", "src4", 1), (207, texts[0], "en", "src4", 1), (208, "ünïcödé 日本語 \x85 a\x1cb c", "de", "src0", 1)]
    return out


def table(spark, data=None, extra=False):
    df = spark.createDataFrame(rows() if data is None else data, DOCS)
    if extra:
        for c in ("tk", "h9", "raw", "__tk", "fp", "words", "w", "lines", "pos", "n", "u"):
            df = df.selectExpr("*", f"'clash' AS {c}")
    return df


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
