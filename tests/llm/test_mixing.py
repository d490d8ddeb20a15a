import hashlib
import re
from fractions import Fraction

import pytest
from helpers import DOCS, rows, rows_of, table
from pyspark.sql import functions as F

from leafmill.llm import queries, sql
from leafmill.llm.mixing import allocate, mix, take_mix

LEVELS = ["domain", "lang", "source"]


def fill(children, budget):
    """Water filling by exact fractions: {name: (weight, cap)} -> shares."""
    give, todo, left = {}, dict(children), Fraction(budget)
    while todo:
        total = sum(w for w, _ in todo.values())
        full = [n for n, (w, cap) in todo.items() if cap <= left * w / total]
        if not full:
            return give | {n: left * w / total for n, (w, _) in todo.items()}
        for n in full:
            give[n] = Fraction(todo.pop(n)[1])
        left = Fraction(budget) - sum(give.values())
    return give


def test_shares_equal_exact_water_filling(spark):
    leaves = [("web", "en", "a", 100), ("web", "en", "b", 10), ("web", "de", "c", 1000), ("books", "en", "d", 30), ("books", None, "e", 5), ("code", "en", "f", 0)]
    weights = {"domain": {"web": 5, "books": 3}, "lang": {"en": 4, "de": 2}, "source": {"a": 3}}
    w = lambda level, v: weights[level].get(v, 1)
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    for budget in (0, 50, 400, 1000, 5000):
        got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in allocate(df, LEVELS, weights, budget, 2).collect()}
        want = {}
        tops = fill({d: (w("domain", d), sum(2 * x[3] for x in leaves if x[0] == d)) for d in {x[0] for x in leaves}}, budget)
        for d, b in tops.items():
            mids = fill({k: (w("lang", k), sum(2 * x[3] for x in leaves if x[:2] == (d, k))) for k in {x[1] for x in leaves if x[0] == d}}, b)
            for k, c in mids.items():
                want |= {(d, k, s): g for s, g in fill({x[2]: (w("source", x[2]), 2 * x[3]) for x in leaves if x[:2] == (d, k)}, c).items()}
        assert set(got) == set(want) and all(want[k] - 3 <= got[k] <= want[k] for k in got), (budget, got, want)
        assert sum(got.values()) <= budget and all(got[k] <= 2 * x[3] for x in leaves for k in [x[:3]])


def brute(data, give, seed):
    out = []
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for leaf, budget in give.items():
        docs = [r for r in data if (r[2], r[3]) == leaf]
        tokens = sum(n(r[1]) for r in docs)
        if not tokens:
            continue
        full, rest = divmod(budget, tokens)
        places = {}
        for r in docs:
            places.setdefault(hashlib.md5(f"{seed}:{full + 1}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), []).append(r)
        total, taken = 0, set()
        for place in sorted(places):
            total += sum(n(r[1]) for r in places[place])
            if rest and total <= rest:
                taken.add(place)
        out += [(r[0], r[2], r[3], n(r[1]), full + (p in taken)) for p, rs in places.items() for r in rs if full + (p in taken)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("share", [0.1, 0.5, 1.0, 1.7])
def test_prefixes_equal_brute_force(spark, share):
    data = rows()
    df = table(spark, extra=False)
    got = rows_of(mix(df, ["lang", "source"], {"lang": {"en": 3}}, share=share, seed=11), "doc_id", "lang", "source", "n_tokens", "copies")
    leaves = df.withColumn("t", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))).groupBy("lang", "source").agg(F.sum("t").alias("tokens"))
    total = leaves.agg(F.sum("tokens")).first()[0]
    give = {(r["lang"], r["source"]): r["budget"] for r in allocate(leaves, ["lang", "source"], {"lang": {"en": 3}}, int(share * total), 2).collect()}
    assert got == brute(data, give, 11)


def test_large_leaf_descends(spark):
    """Over a thousand rows in one interval of the hash, so several passes."""
    df = spark.range(300_000).selectExpr("id AS doc_id", "'a b c' AS text", "'en' AS lang", "'s' AS source")
    got = mix(df, ["lang", "source"], {}, budget=400_001, seed=3)
    assert got.agg(F.sum("copies"), F.max("copies")).first()[:] == (133_333, 1)
    assert mix(df, ["lang", "source"], {}, budget=10**9, max_epochs=2).where("copies = 2").count() == 300_000


def test_take_mix_repeats_rows_and_keeps_columns(spark):
    df = table(spark, extra=True)
    levels = {"language": F.col("lang"), "origin": F.col("source")}
    out = take_mix(df, levels, {"language": {"en": 3}}, share=1.0)
    plan = {r["doc_id"]: r["copies"] for r in mix(df.select("doc_id", "text", F.col("lang").alias("language"), F.col("source").alias("origin")), ["language", "origin"], {"language": {"en": 3}}, share=1.0).collect()}
    assert out.columns == df.columns
    times = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert times == {k: v * (2 if k == 207 else 1) for k, v in plan.items()}
    assert take_mix(spark.createDataFrame([], DOCS), levels, {}).count() == 0
    with pytest.raises(ValueError):
        take_mix(df, {"tokens": F.col("lang")}, {})


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    table(spark).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows_of(queries.op6(spark, str(tmp_path)), "doc_id", "domain", "lang", "source", "n_tokens", "copies") == sorted(con.execute(sql.MIXING).fetchall(), key=repr)
