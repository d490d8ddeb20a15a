"""Detection, the engine, filters, lowering, reports, resources, manifests and relations on Spark."""

import json

import packages as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.functions.limits import Limits
from leafmill.functions.markdown_writer import render
from leafmill.functions.tree import Document, Node
from leafmill.operators import filters, manifest, relations, reports, resources
from leafmill.operators.convert import Engine, files, pixel_size
from leafmill.plans import lowering
from leafmill.sources import detect, text

ENGINE = Engine()


def docs(spark, *rows):
    return spark.createDataFrame([(i, n, c if isinstance(c, bytes) else c.encode()) for i, (n, c) in enumerate(rows)], "doc_id long, name string, content binary")


def parsed(spark, *html):
    return ENGINE.parse(docs(spark, *[("p.html", h) for h in html]))


def markdown(df):
    return [r["artifact"] for r in ENGINE.render(df).orderBy("doc_id").collect()]


def test_detection(spark):
    df = docs(spark, ("a.docx", P.REPORT), ("a", P.xlsx()), ("b.txt", P.pdf(b"")), ("c.xyz", "plain"), ("d.md", "# x"), ("e.odt", P.pack({"x": "y"})), ("f", P.pack({"x": "y"})), ("g.xls", P.xls()), ("h", P.doc("x\r")), ("dir.md/none", "x"))
    fmt, code = detect.resolve(F.col("name"), F.col("content"))
    got = [(r[0], r[1]) for r in df.select(fmt, code, "doc_id").orderBy("doc_id").collect()]
    assert got == [("docx", None), ("xlsx", None), ("pdf", "core.extension-mismatch"), (None, "core.undetectable-input-format"), ("markdown", None), ("odt", None), ("docx", None), ("xls", None), ("doc", None), (None, "core.undetectable-input-format")]
    fmt, code = detect.resolve(F.col("name"), F.col("content"), from_file=True)
    assert df.where("doc_id = 2").select(fmt, code).first()[:] == ("text", None)
    names = spark.createDataFrame([("docs",), ("htlm",), ("zzzzzz",)], "n string")
    assert [r[0] for r in names.select(detect.suggestion(F.col("n"))).collect()] == ["docx", "html", None]


def test_text_expressions(spark):
    df = spark.createDataFrame([("a\r\nb\n \t\n\n c\n",), ("\n\n",), ("x",)], "t string")
    assert [r[0] for r in df.select(text.paragraphs(F.col("t"))).collect()] == [["a\nb", " c"], [], ["x"]]


def test_convert_statuses(spark):
    df = docs(spark, ("a.md", "# T\n\nx [l](u)"), ("b.txt", b"\xff\xfe"), ("c.bin", "?"), ("d.docx", b"PK\x03\x04 word/document"))
    rows = {r["doc_id"]: r for r in ENGINE.convert(df).collect()}
    assert (rows[0]["status"], rows[0]["markdown"], rows[0]["n_blocks"], rows[0]["n_headings"], rows[0]["n_links"]) == ("success", "# T\n\nx [l](u)\n", 2, 1, 1)
    assert [rows[i]["status"] for i in (1, 2, 3)] == ["failed"] * 3 and rows[1]["markdown"] is None
    assert [rows[i]["reports"][0]["code"] for i in (1, 2, 3)] == ["text.invalid-utf8", "core.undetectable-input-format", "docx.not-an-archive"]
    assert Engine(limits=Limits(max_input_bytes=3)).convert(df.where("doc_id = 0")).first()["reports"][0]["contexts"] == ["max_input_bytes"]


def test_parse_then_render_is_convert(spark):
    df = docs(spark, ("a.docx", P.REPORT), ("b.epub", P.epub()), ("c.xlsx", P.xlsx()), ("d.html", "<p>a<b>b</b><ul><li>x"))
    both = ENGINE.convert(df).orderBy("doc_id").collect()
    assert [r["markdown"] for r in both] == markdown(ENGINE.parse(df))


def test_own_reader_and_names(spark):
    def read(content, name, limits):
        d = Document()
        d.body.append(Node("paragraph", kids=[Node("text", text=content.decode().upper())]))
        return d

    e = ENGINE.with_reader("shout", read)
    assert e.convert(docs(spark, ("a.x", "hi")), declared=F.lit("shout")).first()["markdown"] == "HI\n"
    assert e.formats()["shout"] == ["shout"] and len(ENGINE.formats()) == 19
    with pytest.raises(ValueError):
        Engine({"Bad Name": read})


def test_strict_grades(spark):
    df = docs(spark, ("a.html", "<p>x<u>y</u>"), ("b.html", "<table><tr><td colspan=2>x</table>"), ("c.html", "<p>x"), ("d.html", "<svg></svg><p>x"))
    ok = {g: {r["doc_id"] for r in ENGINE.convert(df, strict=g).where("status = 'success'").collect()} for g in lowering.GRADES}
    assert ok == {"off": {0, 1, 2, 3}, "content": {0, 1, 2}, "structure": {0, 2}, "exact": {2}}
    refused = ENGINE.convert(df, strict="exact").where("doc_id = 0").first()
    assert refused["markdown"] is None and [r["code"] for r in refused["reports"]] == ["markdown.style-dropped", "core.strict-refused"]
    with pytest.raises(ValueError):
        ENGINE.convert(df, strict="very")


def test_choice_takes_the_least_price_then_id_then_operation(spark):
    rows = spark.createDataFrame([(1, (0, 1, 0, 0, 0, 0), "b", "x"), (1, (0, 0, 9, 0, 0, 0), "z", "x"), (2, (1, 0, 0, 0, 0, 0), "b", "y"), (2, (1, 0, 0, 0, 0, 0), "b", "x"), (2, (1, 0, 0, 0, 0, 0), "c", "a")], "node int, cost struct<c0:bigint,c1:bigint,c2:bigint,c3:bigint,c4:bigint,c5:bigint>, stable_id string, operation string")
    assert [(r["node"], r["stable_id"], r["operation"]) for r in lowering.choose(rows, ["node"]).orderBy("node").collect()] == [(1, "z", "x"), (2, "b", "x")]


def test_plan_agrees_with_writer(spark):
    df = docs(spark, ("a.docx", P.REPORT), ("b.html", "<div id=a><table><tr><td>x<table><tr><td colspan=3>y</table></table><u>z</u></div><details>q</details><table><caption>c</caption><tr><td><ul><li>x</ul></table>"))
    p = ENGINE.parse(df)
    plan = {(r["doc_id"], r["rule"]): r["uses"] for r in lowering.hits(p).collect()}
    did = {(r["doc_id"], k): v for r in ENGINE.render(p).collect() for k, v in r["losses"].items()}
    assert plan == did


def test_built_in_filters(spark):
    p = parsed(spark, "<h1>Title <i>x</i></h1><h6>six</h6><div><p class=a>in</div><section class='keep drop-1'>s</section>", "<p>first<h1>late</h1>")
    assert markdown(p.transform(filters.shift_headings(2)))[0].startswith("### Title _x_\n\n###### six")
    up = p.transform(filters.promote_first_heading).orderBy("doc_id").collect()
    assert [(m["key"], m["value"]) for m in up[0]["metadata"]] == [("title", "Title x")] and up[1]["metadata"] == []
    assert markdown(p.transform(filters.promote_first_heading))[0].startswith("###### six")
    flat = relations.blocks(p.transform(filters.drop_empty_containers()), "doc_id").where("tag = 'container'").count()
    assert (flat, relations.blocks(p, "doc_id").where("tag = 'container'").count()) == (1, 2)
    left = [b["attrs"]["classes"] for b in p.transform(filters.strip_classes("sec*")).where("doc_id = 0").first()["blocks"] if b["attrs"]]
    assert left == [["keep drop-1"]]
    with pytest.raises(ValueError):
        filters.pipeline(*[filters.shift_headings(0)] * 33)


def test_filters_are_idempotent_and_identity_keeps_rows(spark):
    p = parsed(spark, "<div><div><h2>a</h2></div></div><table><tr><td>x<table><tr><td>y</table></table>")
    for f in (filters.drop_empty_containers(), filters.flatten_nested_tables(), filters.strip_classes("x"), filters.promote_first_heading, filters.shift_headings(0)):
        once = p.transform(f)
        assert markdown(once) == markdown(once.transform(f))
    assert p.transform(filters.tree_filter()).select("blocks", "inlines").collect() == p.select("blocks", "inlines").collect()


def test_flatten_nested_tables_and_own_filters(spark):
    p = parsed(spark, "<table><tr><td>x<table><tr><td>y</table></table><p>a<a href='old'>l</a><b>t</b>")
    out = p.transform(filters.flatten_nested_tables("[table]"))
    assert "x \\[table\\]" in markdown(out)[0] and out.first()["reports"][-1]["code"] == "core.nested-table-flattened"
    out = p.transform(filters.pipeline(filters.replace_link_target(str.upper), filters.tree_filter(lambda b, _: filters.DROP if b.tag == "table" else filters.KEEP, lambda i: filters.UNWRAP if i.tag == "strong" else filters.KEEP)))
    assert markdown(out) == ["a[l](OLD)t\n"]


def test_reports_aggregate(spark):
    rows = spark.createDataFrame([(1, i, "c", "", "", "warning" if i == 3 else "note", 2**62, f"x{i % 6}") for i in range(9)], "doc_id int, seq int, code string, consequence string, directions string, severity string, count bigint, context string")
    r = reports.aggregate(rows, "doc_id").first()
    assert (r["count"], r["severity_rank"], r["seq"], r["contexts"]) == (2**63 - 1, 1, 0, ["x0", "x1", "x2", "x3"])
    p = ENGINE.parse(docs(spark, ("a.csv", "a,b\n1\n2\n")))
    assert p.select(reports.as_text("reports")).first()[0] == "note[csv.ragged-row]: a record's width differs from the first's (x2)\n  at record 2, record 3"
    assert json.loads(p.select(reports.as_json("reports")).first()[0])[0]["count"] == 2
    assert reports.worst(reports.aggregate(reports.exploded(p, "doc_id"), "doc_id"), "doc_id").first()["worst"] == 0


def test_resources(spark):
    body = P.para('<w:r><w:drawing><wp descr="alt"/><a:blip r:embed="i1"/></w:drawing></w:r>')
    p = ENGINE.parse(docs(spark, ("a.docx", P.docx(body))))
    r = relations.resources(p, "doc_id").first()
    assert (r["kind"], r["pixel_width"], r["pixel_height"], len(r["digest"])) == ("embedded", 3, 2, 64)
    assert ENGINE.render(p, F.lit("a")).first()["artifact"] == "![alt](a_media/image-1.png)\n"
    rows = spark.createDataFrame([(1, 1, "s", "image/png", "embedded"), (1, 0, "s", "image/gif", "embedded"), (1, 2, "t", "x", "external")], "doc_id int, idx int, source string, mime string, kind string")
    assert {(x["source"], x["idx"]) for x in resources.first_wins(rows).collect()} == {("s", 0), ("t", 2)}
    assert [x["name"] for x in resources.resource_rows(rows, F.lit("d")).orderBy("idx").collect()] == ["d_media/image-1.gif", "d_media/image-2.png", None]
    assert pixel_size(None) == (None, None) and pixel_size(b"GIF89a\x02\x00\x03\x00") == (2, 3)


def test_manifest_is_canonical_and_staleness(spark):
    df = docs(spark, ("a.docx", P.REPORT))
    one, two = ([r["manifest"] for r in manifest.manifest(ENGINE.render(ENGINE.parse(df, keep=("doc_id", "content"))), F.col("content")).collect()] for _ in range(2))
    assert one == two
    m = json.loads(one[0])
    assert list(m) == sorted(m) and m["schema_version"] == 1 and "merged" in m["reports"][0]["code"]
    assert one[0] == json.dumps(m, separators=(",", ":"), ensure_ascii=False, sort_keys=True)
    digest = m["source"]["digest"]["hex"]
    now = spark.createDataFrame([(0, digest), (1, "other"), (2, "x"), (3, "x")], "doc_id int, digest string")
    side = spark.createDataFrame([(0, one[0]), (1, one[0]), (2, "{broken")], "doc_id int, manifest string")
    assert [r["state"] for r in manifest.fresh(now, side).orderBy("doc_id").collect()] == ["fresh", "stale", "malformed", "missing"]
    plugins = spark.createDataFrame([([("a", 1, "new")], [("a", 1, "old"), ("b", 2, "kept")])], "n array<struct<id:string,version:int,data:string>>, o array<struct<id:string,version:int,data:string>>")
    assert [x["data"] for x in plugins.select(manifest.carry("n", "o")).first()[0]] == ["new", "kept"]


def test_relations(spark):
    p = ENGINE.parse(docs(spark, ("a.docx", P.REPORT), ("b.pptx", P.pptx()), ("c.epub", P.epub())))
    assert relations.violations(p, "doc_id").count() == 0
    inside = relations.containment(relations.blocks(p, "doc_id").select("doc_id", "node", "subtree_len", "tag"), "doc_id", outer=F.col("tag") == "table")
    assert inside.groupBy("doc_id").count().collect()[0]["count"] == 10
    assert relations.facets(p, "layout", "surface string, width long", "doc_id").where("surface = 'slide'").count() == 4
    assert [r["value"] for r in relations.metadata(p, "doc_id").collect()] == ["Book"]
    b = relations.blocks(p.where("doc_id = 0"), "doc_id")
    assert relations.roots(b).count() == 5 and relations.roots(b, 1).count() == 1
    assert {r["tag"] for r in relations.children(b, b.where("tag = 'table'"), "doc_id").collect()} == {"table_head", "table_body"}
    table = lowering.capabilities(spark)
    assert table.where("disposition = 'exact' and rule is null").count() == 18 + 14 and table.where("rule = 'style-dropped'").count() == 4
    assert "Harvest" in {r["text"] for r in relations.subtree_text(p, "doc_id").collect()}
    assert relations.side_violations(p, "doc_id").count() == 0
    loose = p.where("doc_id = 1").withColumn("facets", F.transform("facets", lambda f: f.withField("entity", f["entity"] + 100)))
    assert {r["rule"] for r in relations.side_violations(loose, "doc_id").collect()} == {"unbound-facet"}
    bad = p.where("doc_id = 0").withColumn("blocks", F.transform("blocks", lambda b: F.when(b["tag"] == "heading", b.withField("level", F.lit(9))).when(b["tag"] == "table_row", b.withField("tag", F.lit("quote"))).otherwise(b)))
    assert {r["rule"] for r in relations.violations(bad, "doc_id").collect()} == {"heading-level", "placement"}


def test_files_source(spark, tmp_path):
    (tmp_path / "a.md").write_text("# x")
    (tmp_path / "b.docx").write_bytes(P.REPORT)
    df = ENGINE.convert(files(spark, str(tmp_path)))
    assert {r["format"]: r["n_headings"] for r in df.collect()} == {"markdown": 1, "docx": 1}
    few = ENGINE.convert(files(spark, str(tmp_path), Limits(max_input_bytes=10)))  # a file over the limit is a refused row
    assert {r["format"]: (r["status"], [x["code"] for x in r["reports"]]) for r in few.collect()} == {"markdown": ("success", []), "docx": ("failed", ["core.input-too-large"])}


def test_writer_details():
    def text(*words):
        return [x for w in words for x in (Node("text", text=w), Node("space"))][:-1]

    def out(*blocks):
        d = Document()
        d.body = list(blocks)
        return render(d)[0]

    item = lambda *b: Node("list_item", kids=list(b))
    plain = lambda *w: Node("plain", kids=text(*w))
    assert out(Node("list", kids=[item(plain("one")), item(plain("two"), Node("list", kids=[item(plain("three"))], kind="ordered", start=3, style="decimal", delimiter="period"))], kind="unordered")) == "- one\n- two\n  3. three\n"
    assert out(Node("quote", kids=[Node("paragraph", kids=text("first")), Node("paragraph", kids=text("second"))])) == "> first\n>\n> second\n"
    assert out(Node("code_block", text="let a = `tick`;\n```\nmore\n", attrs={"classes": ["rust"]})) == "````rust\nlet a = `tick`;\n```\nmore\n````\n"
    assert out(Node("paragraph", kids=text("Plain", "*stars*", "and", "2", "+", "2."))) == "Plain \\*stars\\* and 2 + 2.\n"
    styled = Node("strong", kids=[Node("space"), Node("text", text="x"), Node("space")])
    assert out(Node("paragraph", kids=[Node("text", text="a"), styled, Node("text", text="b"), Node("emphasis", kids=[Node("space")])])) == "a **x** b\n"
    assert out(Node("paragraph", kids=[Node("link", kids=text("t"), url="a b(c)", title='q"')])) == '[t](<a b(c)> "q\\"")\n'
    assert out(Node("paragraph", kids=[Node("code", text="`x")])) == "`` `x ``\n"
    cell = lambda s: Node("table_cell", kids=[plain(s)])
    assert out(Node("table", kids=[Node("table_head", kids=[Node("table_row", kids=[cell("Name"), cell("Count")])]), Node("table_body", kids=[Node("table_row", kids=[cell("a|phä"), cell("3")])])], alignments=["left", "right"])) == "| Name    | Count |\n| :------ | ----: |\n| a\\|phä | 3     |\n"


def test_files_over_the_limit_are_refused(spark, tmp_path):
    from leafmill.operators.convert import all_files
    from leafmill.streaming.files import read_files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# x")
    (tmp_path / "in" / "b.md").write_text("long enough")
    limits = Limits(max_input_bytes=10)
    batch = all_files(spark, str(tmp_path / "in"), limits)
    stream = ENGINE.convert(read_files(spark, str(tmp_path / "in"), limits=limits)).writeStream.format("memory").queryName("over_the_limit").outputMode("append")
    stream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    for df in (ENGINE.convert(batch), ENGINE.parse(batch), spark.table("over_the_limit")):
        got = {r["name"][-4:]: (r["status"], [x["code"] for x in r["reports"]]) for r in df.collect()}
        assert got == {"a.md": ("success", []), "b.md": ("failed", ["core.input-too-large"])}


def test_sink_saves_artifacts_media_and_manifests(spark, tmp_path):
    from leafmill.operators.manifest import manifest
    from leafmill.operators.sink import save

    rows = docs(spark, ("a.docx", P.docx(P.para('<w:r><w:drawing><wp descr="alt"/><a:blip r:embed="i1"/></w:drawing></w:r>' + P.run("kept")))), ("b.md", b"# B"), ("c.bin", b"?"))
    stem = F.concat(F.lit("out-"), F.col("doc_id").cast("string"))
    made = manifest(ENGINE.render(ENGINE.parse(rows, keep=("doc_id", "content")), stem), F.col("content"))
    folder = str(tmp_path / "out")
    for _ in range(2):  # a task that runs again finds its own files
        got = {r["doc_id"]: (r["n_media"], r["status"], r["code"]) for r in save(made, folder, stem).collect()}
        assert got == {0: (1, "saved", None), 1: (0, "saved", None), 2: (0, "failed", None)}
    assert (tmp_path / "out" / "out-0.md").read_text() == "![alt](out-0_media/image-1.png)kept\n"
    assert (tmp_path / "out" / "out-0_media" / "image-1.png").read_bytes() == P.PNG and '"schema":"leafmill.manifest"' in (tmp_path / "out" / "out-1.md.leafmill.json").read_text()
    (tmp_path / "out" / "out-1.md").write_text("other")
    assert {r["doc_id"]: r["code"] for r in save(made, folder, stem).collect()}[1] == "core.destination-exists" and (tmp_path / "out" / "out-1.md").read_text() == "other"
    assert {r["doc_id"]: r["status"] for r in save(made, folder, stem, overwrite=True).collect()}[1] == "saved" and (tmp_path / "out" / "out-1.md").read_text() == "# B\n"
    assert not list((tmp_path / "out").glob(".*"))


def test_described_filters_contexts_and_validation(spark):
    def visit(node, above, ctx):
        if node.tag == "heading":
            ctx.set_meta("title", node.kids)
            ctx.report("team.seen", context=str(node.p["level"]))
            return ctx.heading_level(ctx.attrs(node, id="top"), 9) and filters.KEEP
        return filters.KEEP

    own = filters.Described(filters.tree_filter(visit, lambda i, ctx: ctx.link_target(i, "/x") and filters.KEEP if i.tag == "link" else filters.KEEP, with_context=True), "team.head", "marks headings", order="top-down", block_tags=("heading",))
    p = ENGINE.parse(docs(spark, ("a.md", b"# One *two*\n\n[l](y)\n"), ("b.md", b"text\n")))
    out = p.transform(filters.pipeline(own))
    r = ENGINE.render(out).where("doc_id = 0").first()
    assert (r["status"], r["artifact"]) == ("success", "###### One _two_ {#top}\n\n[l](/x)\n")
    assert [(m["key"], m["value_type"], m["value"]) for m in r["metadata"]] == [("title", "inlines", "One two")] and [(x["code"], x["contexts"]) for x in r["reports"]] == [("team.seen", ["1"])]
    spoil = filters.Described(lambda df: df.withColumn("blocks", F.transform("blocks", lambda b: b.withField("tag", F.lit("table_row")))), "team.spoil")
    bad = {r["doc_id"]: r for r in p.transform(filters.pipeline(own, spoil)).collect()}
    assert bad[1]["status"] == "failed" and [(x["code"], x["consequence"], x["contexts"]) for x in bad[1]["reports"]] == [("core.filter-broke-document", "placement", ["team.spoil"])]
    assert {r["status"] for r in p.transform(filters.pipeline(spoil, validate=False)).collect()} == {"success"}
    for wrong in (lambda: filters.Described(own, "Team"), lambda: filters.Described(own, "a.b", order="sideways"), lambda: filters.Described(own, "a.b", block_tags=("p",)), lambda: filters.pipeline(own, own)):
        with pytest.raises(ValueError):
            wrong()


def test_proposals_and_delegating_selection(spark):
    """A container is written by its children unless dropping it costs less; children are priced only where they are written."""
    p = ENGINE.parse(docs(spark, ("a.html", b"<div class=x><p>a</p><div class=y><p>b</p></div></div><dl></dl><p>c</p>")))
    b = relations.blocks(p, "doc_id")
    ways = lowering.proposals(b, "doc_id")
    assert ways.groupBy("node").count().agg(F.max("count")).first()[0] <= lowering.MOST_ALTERNATIVES
    chosen = {(r["parent"], r["node"]): (r["operation"], r["total"]["c0"], r["total"]["c2"]) for r in lowering.selected(ways, "doc_id", depth=3).collect()}
    top = {k: v for k, v in chosen.items() if k[0] is None}
    assert ("children", 0, 2) in top.values() and {v[0] for v in chosen.values()} == {"children", "exact"}
    dear = ways.withColumn("cost", F.when(F.col("operation") == "exact", F.col("cost").withField("c0", F.lit(2).cast("bigint"))).otherwise(F.col("cost")))
    again = [r for r in lowering.selected(dear, "doc_id", depth=3).where("parent is null").collect() if r["operation"] == "drop"]
    assert [(r["total"]["c0"], r["total"]["c2"]) for r in again] == [(1, 0)]


def test_plan_from_nested_rows_equals_the_writer(spark):
    """Every rule, inside tables, notes and nested tables, and in notes that nothing refers to."""
    from leafmill.functions.tree import flatten

    def text(s):
        return Node("text", text=s)

    def cell(*kids, **p):
        return Node("table_cell", kids=list(kids), **p)

    def plain(*kids):
        return Node("plain", kids=list(kids))

    def table(*rows, **p):
        return Node("table", kids=[Node("table_head", kids=[Node("table_row", kids=list(r)) for r in rows])], **p)

    inner = table([cell(Node("container", kids=[plain(text("x"))], attrs={"id": "deep"}))])
    d = Document()
    d.body = [
        table([cell(plain(text("a")), Node("paragraph", kids=[text("b")]), col_span=2), cell(inner), cell(Node("list", kids=[Node("list_item", kids=[plain(text("i"))])], kind="ordered", style="lower_alpha", start=1)), cell(plain(text("one")))]),
        Node("table", kids=[Node("caption", kids=[Node("paragraph", kids=[Node("underline", kids=[text("u")])])]), Node("table_body", kids=[Node("table_row", kids=[cell(plain(text("z")), row_span=2)])])]),
        Node("container", kids=[Node("definition_list", kids=[Node("definition_entry", kids=[Node("definition_term", kids=[text("t")]), Node("definition_body", kids=[Node("paragraph", kids=[text("d")])])])])], attrs={"classes": ["k"]}),
        Node("raw_block", text="<x>", format="latex"), Node("extension", kids=[Node("paragraph", kids=[Node("superscript", kids=[text("s")]), Node("raw", text="r", format="tex"), Node("note", note=0)])], owner="o", name="n", version=1),
    ]
    d.notes = [[Node("extension", kids=[Node("paragraph", kids=[text("n")])], owner="o", name="n", version=1)], [Node("raw_block", text="never", format="tex")]]
    blocks, inlines = flatten(d)
    from leafmill import schema
    from leafmill.operators.convert import arrow_schema

    rows = spark.createDataFrame(pa.Table.from_pylist([{"doc_id": 0, "blocks": blocks, "inlines": inlines}], schema=arrow_schema(f"doc_id bigint, blocks array<{schema.BLOCK}>, inlines array<{schema.INLINE}>")))
    want = render(d)[1]
    assert rows.select(lowering.uses().alias("u")).first()["u"] == want and len(want) >= 9
    assert {r["rule"]: r["uses"] for r in lowering.hits(rows).collect()} == want


def test_media_names_are_the_same_with_and_without_filters(spark):
    rows = docs(spark, ("a.docx", P.docx(P.para('<w:r><w:drawing><wp descr="alt"/><a:blip r:embed="i1"/></w:drawing></w:r>'))))
    for more in ({}, {"filters": [filters.shift_headings(0)]}):
        assert ENGINE.convert(rows, media_stem=F.lit("x"), **more).first()["markdown"] == "![alt](x_media/image-1.png)\n"
        assert ENGINE.convert(rows, **more).first()["markdown"] == "![alt](document_media/image-1.png)\n"


def test_writers_and_their_contract(spark):
    def shout(doc, names):
        return render(doc, names)[0].upper(), {}

    def lines(content, name, limits):
        d = Document()
        d.body = [Node("paragraph", kids=[Node("text", text=x)]) for x in content.decode().split("|")]
        return d

    own = ENGINE.with_writer("shout", shout, "loud").with_reader("bars", lines, "bar", "bars")
    assert own.formats()["bars"] == ["bar", "bars"] and own.formats()["shout"] == ["loud"]
    rows = docs(spark, ("x.bar", b"a|b"), ("y.md", b"# c"), ("z.none", b"?"))
    got = [(r["format"], r["status"], r["markdown"]) for r in own.convert(rows, to="shout").orderBy("doc_id").collect()]
    assert got == [("bars", "success", "A\n\nB\n"), ("markdown", "success", "# C\n"), (None, "failed", None)]
    assert [r["artifact"] for r in own.render(own.parse(rows), to="shout").orderBy("doc_id").collect()] == ["A\n\nB\n", "# C\n", None]
    for wrong, kind in ((lambda: own.with_writer("Loud", shout), ValueError), (lambda: own.with_writer("other", shout, "md"), ValueError), (lambda: own.with_writer("other", "no"), TypeError), (lambda: own.convert(rows, to="none"), ValueError)):
        with pytest.raises(kind):
            wrong()


def test_limits_refuse_one_document(spark):
    from leafmill.functions.tree import Builder

    def refused(limits, *files):
        return [(r["status"], [x["code"] for x in r["reports"]], [c for x in r["reports"] for c in x["contexts"]]) for r in Engine(limits=limits).convert(docs(spark, *files)).orderBy("doc_id").collect()]

    assert refused(Limits(max_output_bytes=6), ("a.md", b"short"), ("b.md", b"longer text")) == [("success", [], []), ("failed", ["core.output-too-large"], ["max_output_bytes"])]
    assert refused(Limits(max_facet_rows=2), ("a.xlsx", P.xlsx())) == [("failed", ["core.limit-exceeded"], ["max_facet_rows"])]
    image = P.docx(P.para('<w:r><w:drawing><wp descr="alt"/><a:blip r:embed="i1"/></w:drawing></w:r>'))
    assert refused(Limits(max_resource_bytes=10), ("a.docx", image)) == [("failed", ["core.limit-exceeded"], ["max_resource_bytes"])]
    out = Builder(Limits(max_report_groups=2, max_report_samples=1))
    for k in range(5):
        out.report(f"x.{k}")
        out.report("x.0", context=str(k))
    assert [(r.code, r.count, r.contexts) for r in out.doc.reports] == [("x.0", 6, ["0"]), ("x.1", 1, []), ("core.reports-truncated", 3, [])]
