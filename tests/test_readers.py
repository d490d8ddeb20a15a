"""Each reader on files built in code, hostile packages, and properties over random bytes."""

import random
import struct
import zipfile
import zlib

import packages as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.functions.limits import DEFAULT, LimitExceeded, Limits
from leafmill.functions.markdown_writer import render
from leafmill.functions.tree import Refused, flatten, unflatten
from leafmill.operators.convert import parse_one
from leafmill.sources import csv, registry

READ = registry.READERS


def md(fmt: str, content: bytes | str, name: str = "x") -> str:
    return render(READ[fmt](content.encode() if isinstance(content, str) else content, name, DEFAULT))[0]


def codes(fmt: str, content: bytes) -> set[str]:
    return {r.code for r in READ[fmt](content, "x", DEFAULT).reports}


def test_text():
    assert md("text", "one *\ntwo\n\n  \t\nthree\r\nfour\r\n") == "one \\*\ntwo\n\nthree\nfour\n"
    assert md("text", "") == ""
    with pytest.raises(Refused, match="text.invalid-utf8"):
        md("text", b"\xff\xfe")


def test_nbsp_is_text_and_blanks_collapse():
    assert md("text", "a\u00a0 \t b") == "a\u00a0 b\n"


def test_csv():
    assert csv.records('a,"b ""q"", c"\r\n\n1,2\r3,', ",") == [["a", 'b "q", c'], ["1", "2"], ["3", ""]]
    assert csv.records('x"y z"w,1', ",") == [["xy zw", "1"]]
    assert md("csv", "a\tb\n1\t2\n", "f.tsv") == "| a   | b   |\n| --- | --- |\n| 1   | 2   |\n"
    assert codes("csv", b"a,b\n1\n") == {"csv.ragged-row"}
    assert READ["csv"](b"", "x", DEFAULT).body == []
    with pytest.raises(Refused, match="csv.unterminated-quote"):
        md("csv", 'a,"b')


def test_html_soup():
    out = md("html", "<head><title>no</title></head><h2>Head</h2><p>a <em>b</em> <a href='u?a=1&amp;b'>c</a><p>next<ul><li>one<li>two</ul><div class=w>in</div><pre>x &lt; y</pre><br>")
    assert out.startswith("## Head\n\na _b_ [c](u?a=1&b)\n\nnext\n\n- one\n\n- two\n\nin\n\n```\nx < y\n```\n")


def test_html_tables_entities_and_details():
    out = md("html", "<table><tr><th>a<th>b<tr><td colspan=2 rowspan=x>x<p>y</table>")
    assert out == "| a   | b   |\n| --- | --- |\n| x y |     |\n"
    assert md("html", "<p>&copy; &notit; &#65;&#x42; &nosuch; &amp") == "© ¬it; AB \\&nosuch; &\n"
    doc = READ["html"](b"<details></details><details><summary>s</summary><details>in</details></details>", "x", DEFAULT)
    assert [b.tag for b in doc.body] == ["extension", "extension"] and doc.body[0].kids[0].tag == "paragraph"
    assert codes("html", b"<svg><p>x</p></svg><script>a</script>") == {"html.skipped-embedded-content"}


def test_html_mismatched_and_code():
    assert md("html", "<p><b>x <i>y</p><p>z <kbd>k<b>2</b></kbd> t") == "**x _y_**\n\nz `k2` t\n"


@pytest.mark.parametrize("text", [
    '# A Title\n\nAn *early* **cold** [spring](http://example.com "rains") and\n`code with backticks` plus ~~gone~~ text.\n\nan autolink <https://example.org/>.\n',
    "- one\n- two\n  1. nested three\n  2. nested four\n\n> quoted\n>\n> second\n\n```rust\nlet n = 3;\n```\n\n---\n\nLoose:\n\n- alpha\n\n- beta\n",
    "| Name | Count |\n| :--- | ----: |\n| alpha | 3 |\n| be\\|ta | 14 |\n\nSee [the docs][ref].\n\n[ref]: https://example.com/docs \"Docs\"\n",
    "Some text with a note[^a] in it.\n\n[^a]: Kept at the foot.\n", "Setext Title\n============\n\nSubtitle\n--------\n\n### Deep ###\n", "Literal \\*stars\\* and \\[x\\] &amp; 5 < 6 \\_a\\_\n\n    code\n",
])
def test_markdown_reaches_a_fixed_point(text):
    once = md("markdown", text)
    assert md("markdown", once) == once


def test_markdown_details():
    assert md("markdown", "a\\\nb  \nc") == "a\\\nb\\\nc\n"
    assert md("markdown", "***both*** a_b_c **un closed") == "_**both**_ a_b_c \\*\\*un closed\n"
    assert md("markdown", "[a]: /x\n\n[a] [b][a] [c]") == "[a](/x) [b](/x) \\[c\\]\n"
    assert md("markdown", "> a\nlazy\n\nb") == "> a\n> lazy\n\nb\n"
    assert md("markdown", "~~~\nx\n~~~\n") == "```\nx\n```\n"
    assert md("markdown", "- a\n\n  b\n- c") == "- a\n\n  b\n\n- c\n"
    assert md("markdown", "* * * x\n\n***\n") == "- - - x\n\n---\n"
    assert md("markdown", "a|b|c\n-|-\n1\n2|3|4\n") == "| a   | b   |\n| --- | --- |\n| 1   |     |\n| 2   | 3   |\n"
    assert md("markdown", "text[^n]\n[^n]: note\nmore\n\n    second\n") == "text[^1]\n\n[^1]: note\n      more\n\n      second\n"
    assert md("markdown", "<div>\n*x*\n\n*y*") == "<div>\n*x*\n\n_y_\n"


def test_docx_report():
    doc = READ["docx"](P.REPORT, "x", DEFAULT)
    assert render(doc)[0] == (
        "# Harvest\n\nWeighed **_ripe dry_** by one [link](https://example.org/) and counted[^1].\n\n1. barley\n   - six-row\n2. oats\n\n"
        "| Name               | Count |\n| ------------------ | ----- |\n| one for both sides |       |\n\nwhat is left\n\n[^1]: Kept at the foot.\n"
    )
    assert {r.code for r in doc.reports} == {"docx.merged-cells-degraded"}


def test_docx_fields_styles_images_revisions():
    body = (
        P.para('<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> HYPERLINK "http://q" </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r>' + P.run("shown") + '<w:r><w:fldChar w:fldCharType="end"/></w:r>')
        + P.para(P.run("sub head"), '<w:pStyle w:val="Sub"/>') + P.para(P.run("mono", '<w:rFonts w:ascii="Courier New"/>') + P.run(" x", "<w:b w:val='0'/>"), '<w:pStyle w:val="Odd"/>')
        + P.para('<w:r><w:drawing><wp descr="alt"/><a:blip r:embed="i1"/></w:drawing></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del>' + P.run("kept"))
    )
    doc = READ["docx"](P.docx(body), "x", DEFAULT)
    assert render(doc)[0] == "[shown](http://q)\n\n# sub head\n\n`mono` x\n\n![alt](word/media/a.png)kept\n"
    assert doc.plugins["org.leafmill.docx"] == (1, {"paragraph_style_ids": ["Odd"]})
    assert doc.resources[0]["mime"] == "image/png" and any(f["kind"] == "revision" for f in doc.facets)
    assert "docx.tracked-deletions-dropped" in {r.code for r in doc.reports}


def test_office_family():
    assert md("xlsx", P.xlsx()) == "## S1\n\n| Name       |       | 1.50 |\n| ---------- | ----- | ---- |\n| 2020-01-01 | 12.5% | TRUE |\n"
    assert md("pptx", P.pptx()) == "## Deck\n\n- point\n\nplain\n\nsay this\n"
    doc = READ["epub"](P.epub(), "x", DEFAULT)
    assert render(doc)[0] == "# One\n\n![pic](OPS/x.png)\n\n# Two\n" and doc.metadata == [("title", "Book")]
    with pytest.raises(Refused, match="epub.drm-refused"):
        READ["epub"](P.epub(**{"META-INF/encryption.xml": "<e/>"}), "x", DEFAULT)
    with pytest.raises(Refused, match="epub.missing-container"):
        READ["epub"](P.pack({"a": "b"}), "x", DEFAULT)


def test_odf_family():
    styles = '<style:style style:name="B"><style:text-properties fo:font-weight="bold"/></style:style><style:style style:name="C" style:parent-style-name="B"/>'
    odt = P.odf('<office:text><text:h text:outline-level="2">H</text:h><text:p>a <text:span text:style-name="C">b</text:span><text:note><text:note-body><text:p>n</text:p></text:note-body></text:note></text:p><text:list><text:list-item><text:p>one</text:p></text:list-item></text:list></office:text>', styles)
    assert md("odt", odt) == "## H\n\na **b**[^1]\n\n- one\n\n[^1]: n\n"
    ods = P.odf('<office:spreadsheet><table:table table:name="T"><table:table-row><table:table-cell office:value-type="string"><text:p>a</text:p></table:table-cell><table:table-cell table:number-columns-repeated="2" office:value-type="float" office:value="1.5"/><table:table-cell table:number-columns-repeated="900"/></table:table-row><table:table-row><table:table-cell office:value-type="time" office:time-value="PT1H2M3S"/><table:table-cell office:value-type="percentage" office:value="0.5"/></table:table-row><table:table-row table:number-rows-repeated="1000000"/></table:table></office:spreadsheet>')
    assert md("ods", ods) == "## T\n\n| a        | 1.5 | 1.5 |\n| -------- | --- | --- |\n| 01:02:03 | 50% |     |\n"
    merged = P.odf('<office:spreadsheet><table:table table:name="M"><table:table-row><table:table-cell table:number-columns-spanned="2" office:value-type="string"><office:annotation><text:p>a comment</text:p></office:annotation><text:p>Wide</text:p></table:table-cell><table:covered-table-cell/></table:table-row><table:table-row><table:table-cell><text:p>x</text:p></table:table-cell><table:table-cell table:formula="of:=1"/></table:table-row></table:table></office:spreadsheet>')
    doc = READ["ods"](merged, "x", DEFAULT)
    assert render(doc)[0] == "## M\n\n| Wide |     |\n| ---- | --- |\n| x    |     |\n" and doc.facets[0]["values"]["merge_cols"] == 2
    assert {r.code for r in doc.reports} == {"ods.annotations-dropped", "ods.formula-without-cached-value"}
    odp = P.odf('<office:presentation><draw:page draw:name="P1"><draw:frame presentation:class="title"><draw:text-box><text:p>Tt</text:p></draw:text-box></draw:frame><draw:frame svg:x="1cm"><draw:text-box><text:p>body</text:p></draw:text-box></draw:frame></draw:page></office:presentation>')
    doc = READ["odp"](odp, "x", DEFAULT)
    assert render(doc)[0] == "## Tt\n\nbody\n" and doc.facets[0]["values"]["x"] == 360_000


def test_binary_family():
    assert md("xls", P.xls()) == "## Sheet\n\n| Name   | 2.5  |            |\n| ------ | ---- | ---------- |\n| split! | TRUE | 2021-01-01 |\n| calc   |      |            |\n"
    assert md("xlsb", P.xlsb()) == "## B1\n\n| Name | 2.5 |\n| ---- | --- |\n| TRUE | in  |\n"
    assert md("ppt", P.ppt()) == "## Title\n\none\n\ntwo\\\nmore\n\nnote\n"
    assert md("doc", P.doc('Hi \x13 HYPERLINK "http://a" \x14there\x15 x\rcell\x07next\x0bline\r')) == "Hi [there](http://a) x\n\ncell\n\nnext\\\nline\n"
    with pytest.raises(Refused, match="doc.encryption-refused"):
        READ["doc"](P.doc("x", 0x100), "x", DEFAULT)


def test_light_markup():
    assert md("rst", "Title\n=====\n\nA *b* **c** ``d`` `x <http://y>`_ and ref_ here::\n\n    code\n\nSub\n---\n\n- one\n- two\n\n.. note:: hi\n\n.. _ref: http://z\n") == "# Title\n\nA _b_ **c** `d` [x](http://y) and [ref](http://z) here:\n\n```\ncode\n```\n\n## Sub\n\n- one\n- two\n\nhi\n"
    doc = READ["asciidoc"](b"= T\n:author: me\n\nHello *b* _e_ `c` https://x.org[site]\nline\n\n* one\n** in\n* two\n\n----\ncode\n----\n\nNOTE: care\n\ninclude::x[]\ninclude::y[]\n", "x", DEFAULT)
    assert render(doc)[0] == "# T\n\nHello **b** _e_ `c` [site](https://x.org)\nline\n\n- one\n  - in\n- two\n\n```\ncode\n```\n\ncare\n"
    assert doc.metadata == [("author", "me")] and [(r.code, r.count) for r in doc.reports] == [("asciidoc.include-refused", 1)]


def test_rtf():
    text = rb"""{\rtf1\ansi{\fonttbl{\f0 Arial;}}\pard\outlinelevel0 Head\par\pard Hello {\b bold\i  both} caf\'e9 \u8364? end\line x{\footnote note text}\par\pard\ls1{\pntext 1.\tab}item\par\pard {\field{\*\fldinst HYPERLINK "http://a"}{\fldrslt here}}\b0\par\trowd\trhdr\cellx1\cellx2\intbl A\cell B\cell\row\trowd\cellx1\cellx2\pard\intbl c\cell d\cell\row\pard tail\par}"""
    assert md("rtf", text) == "# Head\n\nHello **bold _both_** café € end\\\nx[^1]\n\n1. item\n\n[here](http://a)\n\n| A   | B   |\n| --- | --- |\n| c   | d   |\n\ntail\n\n[^1]: note text\n"
    with pytest.raises(Refused):
        md("rtf", "plain")
    doc = READ["rtf"](rb"{\rtf1{\stylesheet{\s0 Normal;}{\s1\b Heading 1;}{\*\cs16 Link;}}\pard\s1 Styled{\pict\pngblip 89504e47}{\object 01}\par\pard Plain\par}", "x", DEFAULT)
    assert [f["values"]["name"] for f in doc.facets] == ["Heading 1"] and {r.code for r in doc.reports} == {"rtf.images-dropped", "rtf.objects-dropped"}
    lists = rb"{\rtf1\pard{\listtext \'b7\tab}\ls1\ilvl0 One\par\pard{\listtext \'b7\tab}\ls1\ilvl1 Sub\par\pard{\listtext \'b7\tab}\ls1\ilvl0 Two\par\pard{\*\pn\pnlvlbody\pndec\pnstart1}First\par\pard{\*\pn\pnlvlbody\pndec}Second\par\pard\par}"
    assert md("rtf", lists) == "- One\n\n  - Sub\n\n- Two\n\n1. First\n\n2. Second\n"


PAGE = b"""BT /F1 24 Tf 72 700 Td (Big Title) Tj ET BT /F1 12 Tf 72 660 Td 14 TL (First line of a para-) Tj T* (graph goes on.) Tj 0 -40 Td (Second \\(par\\)) Tj ET
BT /F1 12 Tf 1 0 0 1 80 485 Tm (A1) Tj 1 0 0 1 180 485 Tm (B1) Tj 1 0 0 1 80 465 Tm (A2) Tj 1 0 0 1 180 465 Tm (B2) Tj ET
70 500 200 0.5 re f 70 480 200 0.5 re f 70 460 200 0.5 re f 70 460 0.5 40 re f 170 460 0.5 40 re f 270 460 0.5 40 re f
BT /F1 12 Tf 72 400 Td (x) Tj 100 0 Td (1) Tj -100 -14 Td (y) Tj 100 0 Td (2) Tj -100 -14 Td (z) Tj 100 0 Td (3) Tj ET BT /F2 12 Tf 72 300 Td (A B) Tj ET"""


@pytest.mark.parametrize("flate", [True, False])
def test_pdf(flate):
    doc = READ["pdf"](P.pdf(PAGE, flate), "x", DEFAULT)
    assert render(doc)[0] == "# Big Title\n\nFirst line of a paragraph goes on.\n\nSecond (par)\n\n| A1  | B1  |\n| --- | --- |\n| A2  | B2  |\n\n| x   | 1   |\n| --- | --- |\n| y   | 2   |\n| z   | 3   |\n\né fi\n"
    assert doc.metadata == [("title", "Doc")]


def build_pdf(objects):
    out, at = b"%PDF-1.5\n", {}
    for n, o in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + o + b"\nendobj\n"
    return out, at


def test_pdf_cross_reference_streams_and_object_streams():
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 600 800] >>", b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>"]
    heads, body = "", b""
    for n, o in enumerate(inner, 1):
        heads += f"{n} {len(body)} "
        body += o + b" "
    packed = zlib.compress(heads.encode() + body)
    page = b"BT /F1 12 Tf 72 720 Td (In an object stream) Tj ET"
    objects = {4: b"<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(heads), len(packed)) + packed + b"\nendstream", 5: b"<< /Length %d >>\nstream\n" % len(page) + page + b"\nendstream"}
    out, at = build_pdf(objects)
    rows = b"".join(struct.pack(">BHB", *r) for r in [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at[4], 0), (1, at[5], 0), (1, len(out), 0)])
    # PNG "up" rows, as writers make them
    before, coded = bytes(4), b""
    for i in range(0, len(rows), 4):
        coded += b"\x02" + bytes((a - b) & 255 for a, b in zip(rows[i : i + 4], before, strict=True))
        before = rows[i : i + 4]
    coded = zlib.compress(coded)
    xref = b"<< /Type /XRef /Size 7 /W [1 2 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> /Length %d >>\nstream\n" % len(coded) + coded + b"\nendstream"
    doc = READ["pdf"](out + b"6 0 obj\n" + xref + b"\nendobj\nstartxref\n%d\n%%%%EOF" % len(out), "x", DEFAULT)
    assert render(doc)[0] == "In an object stream\n"
    assert [(f["kind"], f["values"].get("y")) for f in doc.facets] == [("provenance", None), ("layout", (800 - 720 - 12) * 12700)]


def test_pdf_images():
    page = b"BT /F1 12 Tf 72 720 Td (text) Tj ET /Im1 Do /Im1 Do /Im2 Do /Im3 Do"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /XObject << /Im1 5 0 R /Im2 6 0 R /Im3 7 0 R >> >> >>",
               4: b"<< /Length %d >>\nstream\n" % len(page) + page + b"\nendstream", 5: b"<< /Subtype /Image /Filter /DCTDecode /Length 2 >>\nstream\n\xff\xd8\nendstream", 6: b"<< /Subtype /Image /Filter /CCITTFaxDecode /Length 1 >>\nstream\n\0\nendstream",
               7: b"<< /Subtype /Image /ColorSpace /DeviceGray /BitsPerComponent 8 /Width 2 /Height 1 /Length 2 >>\nstream\n\x07\x09\nendstream"}
    doc = READ["pdf"](build_pdf(objects)[0] + b"trailer << /Root 1 0 R >>", "x", DEFAULT)
    assert [(r["source"], r["mime"]) for r in doc.resources] == [("pdf-image-1", "image/jpeg"), ("pdf-image-2", "image/png")]
    assert render(doc)[0].count("![](pdf-image-1)") == 2 and "pdf.images-omitted" in {r.code for r in doc.reports}
    png = doc.resources[1]["content"]
    assert zlib.decompress(png[png.index(b"IDAT") + 4 : -16]) == b"\0\x07\x09"


def test_pdf_damaged_and_encrypted():
    good = P.pdf(PAGE)
    assert "Big Title" in md("pdf", good[: good.index(b"xref")])  # no cross references: rebuilt
    with pytest.raises(Refused, match="pdf.encryption-refused"):
        md("pdf", P.pdf(PAGE, more=b"/Encrypt << >> "))


def test_hostile_packages():
    with pytest.raises(Refused, match="docx.doctype-refused"):
        READ["docx"](P.docx("", **{"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'}), "x", DEFAULT)
    with pytest.raises(Refused, match="docx.hostile-archive"):
        READ["docx"](P.docx("", **{"../evil": "x"}), "x", DEFAULT)
    with pytest.raises(Refused, match="docx.not-an-archive"):
        READ["docx"](P.REPORT[:400], "x", DEFAULT)
    with pytest.raises(LimitExceeded, match="max_archive_ratio"):
        READ["docx"](P.docx("", **{"word/document.xml": "<a>" + " " * 3_000_000 + "</a>"}), "x", DEFAULT)
    with pytest.raises(LimitExceeded, match="max_depth"):
        READ["docx"](P.docx("", **{"word/document.xml": "<a>" * 400 + "</a>" * 400}), "x", DEFAULT)
    with pytest.raises(LimitExceeded, match="max_archive_entries"):
        READ["docx"](P.REPORT, "x", Limits(max_archive_entries=2))
    with pytest.raises(ValueError, match="positive"):
        Limits(max_nodes=0)
    assert zipfile.is_zipfile(__import__("io").BytesIO(P.REPORT))


@pytest.mark.parametrize("fmt", sorted(READ))
def test_random_bytes_never_raise(fmt):
    rng = random.Random(fmt)
    seeds = {"pdf": P.pdf(PAGE), "docx": P.REPORT, "xls": P.xls(), "ppt": P.ppt(), "doc": P.doc("abc\r"), "xlsx": P.xlsx(), "xlsb": P.xlsb(), "pptx": P.pptx(), "epub": P.epub()}
    for _ in range(60):
        data = bytearray(seeds.get(fmt) or bytes(rng.randrange(256) for _ in range(rng.randrange(300))))
        for _ in range(rng.randrange(8)):
            if data:
                data[rng.randrange(len(data))] = rng.randrange(256)
        status, doc = parse_one(bytes(data), "x", fmt, None, READ, DEFAULT)
        assert status == "success" or doc.reports


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab *_`[]()<>#-+.1\n\t|~!\\&;é:^\"'")), max_size=120), st.sampled_from(["markdown", "html", "rst", "asciidoc", "text", "csv"]))
def test_any_text_converts_and_flattens(text, fmt):
    status, doc = parse_one(text.encode(), "x", fmt, None, READ, DEFAULT)
    assert not any(r.code == "core.malformed-input" for r in doc.reports), doc.reports
    if status == "success":
        out, hits = render(doc)
        assert render(unflatten(*flatten(doc))) == (out, hits)


