import hashlib
from collections import Counter

from helpers import DOCS, rows, rows_of, table
from pyspark.sql import functions as F

from leafmill.llm import queries, sql
from leafmill.llm.line_dedup import drop_frequent_lines, line_dedup

_LOWER = {c: c + 32 for c in range(65, 91)}


def brute(data, min_docs, min_chars=1):
    split = [(d, (t or "").split("\n")) for d, t, *_ in data]
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(_LOWER)
    seen = Counter(k for _, lines in split for k in {key(x) for x in lines} if len(k) >= min_chars)
    out = []
    for d, lines in split:
        kept = [x for x in lines if not (len(key(x)) >= min_chars and seen[key(x)] >= min_docs)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    for n, m in ((10, 1), (2, 1), (2, 8), (1, 1)):
        assert rows_of(line_dedup(table(spark, extra=True), n, m), "doc_id", "n_lines", "n_dropped", "kept_text") == brute(rows(), n, m)


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    table(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(queries.op10(spark, str(tmp_path)), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(sql.LINE_DEDUP).fetchall(), key=repr)
    assert got == sorted(((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows(), 10)), key=repr)


def test_columns_stay(spark):
    df = table(spark, extra=True)
    out = drop_frequent_lines(df)
    assert out.schema.simpleString() == df.schema.simpleString() and out.count() == df.count()
    assert {r["doc_id"]: r["text"] for r in out.where("doc_id in (100, 200)").collect()} == {100: "own text 0 É\n", 200: None}
    assert out.where(F.col("n_chars") != F.char_length("text")).count() == 0
    assert drop_frequent_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_main_path_is_native(spark):
    assert not any(x in line_dedup(table(spark))._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
