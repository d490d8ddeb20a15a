"""What keeps work in proportion to the input: plans and splits."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.functions import markdown_writer, tree
from leafmill.functions.limits import LimitExceeded, Limits
from leafmill.operators import convert
from leafmill.plans import lowering, queries
from leafmill.sources import csv, text


def test_choice_broadcasts_no_nodes(spark, capsys):
    cost = F.struct(*[F.lit(int(c == "c0")).cast("bigint").alias(c) for c in lowering.COST])
    rows = [(k, n, 0 if n else None) for k in range(50) for n in range(4)]
    ways = spark.createDataFrame(rows, "doc_id long, node long, parent long").select("*", F.lit(0).alias("stable_id"), F.lit("keep").alias("operation"), cost.alias("cost"), F.lit(True).alias("delegates"))
    out = lowering.selected(ways, "doc_id", depth=1)
    chosen = out.collect()
    assert len(chosen) == 200 and {r["total"]["c0"] for r in chosen if r["parent"] is None} == {4}
    out.explain()  # as it ran
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_tasks_grow_in_number_with_the_scan(spark, tmp_path, monkeypatch):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/few")
    scan = spark.read.parquet(f"{tmp_path}/few")
    assert convert.spread(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(convert, "SHARE", 10)
    out = convert.spread(scan)
    assert out.rdd.glom().map(len).collect() == [10] * 10 and out.count() == 100


def test_rules_share_one_pass_over_inlines(spark):
    plan = str(lowering.uses())
    assert plan.count("filter(inlines") == 3  # twice for notes, once for what rules may apply to


def test_manifests_take_one_pass(spark, tmp_path, capsys):
    spark.createDataFrame([(k, f"S{k}", 1.5 * k) for k in range(5)], "s_suppkey long, s_name string, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    out = queries.manifest_digests(spark, str(tmp_path))
    assert out.where("source_agrees").count() == 5
    out.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 2  # one that makes the documents, one that reads and writes them


def test_rendering_in_the_same_pass_gives_the_same(spark):
    rows = [("a.html", "<h1>T</h1><p><u>a</u> b<sup>2</sup><ul><li>x</ul><table><tr><td><table></table></table>"), ("b.csv", "a,b\n1\n"), ("c.csv", 'a,"b'), ("d.md", "![alt](data:image/png;base64,AAAA) *x*"), ("e.nosuch", "x"), ("f.txt", "")]
    docs = spark.createDataFrame([(i, n, c.encode()) for i, (n, c) in enumerate(rows)], "doc_id long, name string, content binary")
    engine = convert.Engine()
    two, one = engine.render(engine.parse(docs), F.lit("m")), engine.parse(docs, to="markdown", media_stem=F.lit("m"))
    assert one.columns == two.columns
    got, want = ([r.asDict(True) for r in x.orderBy("doc_id").collect()] for x in (one, two))
    assert got == want and [r["status"] for r in got] == ["success", "success", "failed", "success", "failed", "success"]
    small = convert.Engine(limits=Limits(max_output_bytes=8))
    got, want = ([r.asDict(True) for r in x.orderBy("doc_id").collect()] for x in (small.parse(docs, to="markdown"), small.render(small.parse(docs))))
    assert got == want and "failed" in {r["status"] for r in got[:2]}


def test_pieces_are_bounded_by_bytes():
    batch = pa.record_batch({"x": list(range(200)), "w": [10] * 100 + [500, None] + [1] * 98})
    got = list(convert.pieces(batch, batch.column("w"), 100))
    assert pa.Table.from_batches(got).to_pydict() == batch.to_pydict()
    assert [p.num_rows for p in got] == [10] * 10 + [1, 64, 35]  # a large row is alone


def test_rows_of_large_tables_are_made_one_at_a_time(monkeypatch):
    cells = "".join(f'{i},"some ""name"" {i}", x  y\r\n' + ("odd|one\n" if i % 50 == 7 else "") for i in range(3000))
    made = {}
    for large in (1 << 60, 1):
        monkeypatch.setattr(csv, "LARGE", large)
        for text in (cells, "only,head\n", "", "a\n\nb"):
            tracemalloc.start()
            doc = csv.read(text.encode())
            held = tracemalloc.get_traced_memory()[0]
            tracemalloc.stop()
            made.setdefault(text, []).append((markdown_writer.render(doc), tree.flatten(doc), doc.reports, tree.flatten(doc)))
            if text == cells:
                assert (held > 20 * len(text)) == (large > 1), held
    assert all(a == b and a[1] == a[3] for a, b in made.values())
    for broken, limits, raised in (("a\n1\n" + 'x,"', Limits(max_nodes=5), tree.Refused), ("a\n1\n2\n3", Limits(max_nodes=5), LimitExceeded)):
        with pytest.raises(raised):
            csv.read(broken.encode(), "", limits)


def test_texts_are_written_as_they_are_read_without_a_tree(spark):
    """Any text gives what its tree gives, with no more than a few objects for each line."""
    r = random.Random(7)
    signs = ["a", "b1", " ", "  ", "\n", "\n", "\t", "\r", "\r\n", "#", ">", "+", "-", "_", "!", "[", "]", "|", "<", "&", "amp;", "*", "\\", "`", "\xa0", "\x0b", "é", "# ", "1. "]
    for s in ["", "\n", "\r\r\n", "a\n\r\r\nb", " a \n b", *("".join(r.choices(signs, k=r.randint(0, 30))) for _ in range(3000))]:
        doc = text.read(s.encode())
        assert text.written(s.encode()).written == (markdown_writer.render(doc)[0], len(doc.body)), s
    with pytest.raises(tree.Refused):
        text.written(b"\xff")
    with pytest.raises(LimitExceeded):
        text.written(b"a b c", "", Limits(max_nodes=3))
    docs = spark.createDataFrame([(0, "d.txt", b"a  b\n\n# c")], "doc_id long, name string, content binary")
    own = convert.Engine().with_reader("text", lambda content, name, limits: text.read(content.upper(), name, limits))
    rows = [e.convert(docs).select("status", "markdown", "n_blocks").first() for e in (convert.Engine(), own)]
    assert rows == [("success", "a b\n\n\\# c\n", 2), ("success", "A B\n\n\\# C\n", 2)]


def test_runs_of_words_are_one_escape(monkeypatch):
    calls = []
    real = markdown_writer.escape
    monkeypatch.setattr(markdown_writer, "escape", lambda *a: calls.append(a) or real(*a))
    doc = text.read(b"#a _b_ c_d\n# e\nf &amp; !x [y\n")
    assert markdown_writer.render(doc)[0] == "\\#a \\_b\\_ c_d\n\\# e\nf \\&amp; !x \\[y\n" and len(calls) == 1
