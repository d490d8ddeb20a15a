import random
import re
from itertools import combinations

import numpy as np
import xxhash
from helpers import DOCS, rows, rows_of, table

from leafmill.llm.components import components
from leafmill.llm.simhash import SETS, fingerprint, forest, keep_one, links, simhash_groups


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, ids):
    """component_id by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 3:
            root[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        least.setdefault(find(i), []).append(ids[i])
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_equals_brute_force(spark):
    data = rows()
    fps = [brute_fp(t) for _, t, *_ in data]
    want = sorted(((d, f, c) for (d, *_), f, c in zip(data, fps, groups(fps, [r[0] for r in data]), strict=True)), key=repr)
    got = [(d, f % (1 << 64), c) for d, f, c in rows_of(simhash_groups(table(spark, extra=True)), "doc_id", "fp", "component_id")]
    assert sorted(got, key=repr) == want


def test_links_in_hot_postings(spark):
    """Clusters around few centres: with a low bound, postings are divided twice and no link is lost."""
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = {c for c in centres}
    for _ in range(300):
        x = rng.choice(sorted(fps))
        for _ in range(rng.randrange(1, 5)):
            x ^= 1 << rng.randrange(24)
        fps.add(x)
    fps = sorted(fps)
    ids = list(range(len(fps)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for hot in (4, 50, 10_000):
        edges = links(df, hot)
        assert all(bin((r["u"] ^ r["v"]) & (1 << 64) - 1).count("1") <= 3 for r in edges.collect())
        of = {r["node"] % (1 << 64): r["root"] for r in components(edges).collect()}
        same = lambda i, j: of.get(fps[i], fps[i]) == of.get(fps[j], fps[j])
        want = groups(fps, ids)
        assert all(same(i, j) == (want[i] == want[j]) for i, j in combinations(ids[:120], 2))


def test_sets_cover_every_five_positions():
    assert len(SETS) <= 24 and all(any(set(s) <= set(c) for s in SETS) for c in combinations(range(8), 5))


def test_fingerprint_details():
    assert fingerprint([]) == 0 and fingerprint([b"a", b"b"]) == brute_fp("A b")
    assert fingerprint(b"x y z x y z x y z".split()) == brute_fp("x y z x y z x y z")
    u, v = forest(np.array([0, 1, 3, 7, 0xFFFF, 15], np.int64))
    assert len(u) == 4


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one(spark):
    data = rows()
    fps = [brute_fp(t) for _, t, *_ in data]
    n = len({(c, None if c is not None else f) for c, f in zip(groups(fps, [r[0] for r in data]), fps, strict=True)})
    out = keep_one(table(spark, extra=True))
    assert out.columns == table(spark, extra=True).columns and out.count() == n
    assert out.where("doc_id = 207").count() <= 1
    assert keep_one(spark.createDataFrame([], DOCS)).count() == 0
