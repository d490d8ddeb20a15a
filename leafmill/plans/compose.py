"""Small documents of every format, put together from the fields of a row: what the readers' queries and bench read.

A builder is a function of (key, name, amount) that gives bytes.  The same content goes through all word-processing
formats (heading, styled paragraph with a link and a note, list in a list, table), one table through all spreadsheets, and two
slides through all presentations."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Build = Callable[[int, str, int], bytes]


def composed(rows: DataFrame, build: Build, key: Column, name: Column, amount: Column) -> DataFrame:
    """(doc_id, content) of a document for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [build(*r.values()) for r in batch.to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "content": pa.array(made, pa.binary())})

    return rows.select(key.cast("long").alias("doc_id"), name.alias("name"), amount.cast("long").alias("amount")).mapInArrow(run, "doc_id long, content binary")


def archive(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, data in parts.items():
            z.writestr(path, data, zipfile.ZIP_STORED if path == "mimetype" else None)  # its bytes tell the format
    return out.getvalue()


def relations(*rows: tuple[str, str, str]) -> str:
    each = "".join(f'<Relationship Id="{i}" Type="http://example.org/rel/{kind}" Target="{to}"{" TargetMode=%sExternal%s" % (chr(34), chr(34)) if "://" in to else ""}/>' for i, kind, to in rows)
    return f'<?xml version="1.0"?><Relationships xmlns="http://example.org/rels">{each}</Relationships>'


# ------------------------------------------------------------------ word processing
def docx(key: int, name: str, amount: int) -> bytes:
    ns = 'xmlns:w="http://example.org/w" xmlns:r="http://example.org/r"'

    def r(text: str, style: str = "") -> str:
        return f'<w:r><w:rPr>{style}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'

    def p(inner: str, props: str = "") -> str:
        return f"<w:p><w:pPr>{props}</w:pPr>{inner}</w:p>"

    def li(text: str, level: int) -> str:
        return p(r(text), f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="4"/></w:numPr>')

    def row(*cells: str) -> str:
        return "<w:tr>" + "".join(f"<w:tc>{p(r(c))}</w:tc>" for c in cells) + "</w:tr>"

    body = p(r(name), '<w:pStyle w:val="Chapter"/>')
    body += p(r("Account of ") + r(name, "<w:b/>") + r(" is ") + r(str(amount), "<w:i/>") + r(", see ") + '<w:hyperlink r:id="site">' + r("site") + "</w:hyperlink>" + '<w:r><w:footnoteReference w:id="3"/></w:r>' + r("."))
    body += li(f"one {key}", 0) + li("inner", 1) + li("two", 0)
    body += f"<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/></w:tblGrid>{row('Key', 'Name')}{row(str(key), name)}</w:tbl>" + p(r(f"End of {key}.") + f"<w:del>{r('struck')}</w:del>")
    level = '<w:lvl w:ilvl="{}"><w:start w:val="1"/><w:numFmt w:val="{}"/><w:lvlText w:val="%1."/></w:lvl>'.format
    return archive({
        "_rels/.rels": relations(("d", "officeDocument", "word/document.xml")),
        "word/_rels/document.xml.rels": relations(("site", "hyperlink", f"https://example.org/{key}"), ("notes", "footnotes", "footnotes.xml")),
        "word/styles.xml": f'<w:styles {ns}><w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/></w:style><w:style w:type="paragraph" w:styleId="Chapter"><w:name w:val="chapter"/><w:basedOn w:val="Heading1"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {ns}><w:abstractNum w:abstractNumId="9">{level(0, "decimal")}{level(1, "bullet")}</w:abstractNum><w:num w:numId="4"><w:abstractNumId w:val="9"/></w:num></w:numbering>',
        "word/footnotes.xml": f'<w:footnotes {ns}><w:footnote w:id="3">{p(r(f"Counted for {key}."))}</w:footnote></w:footnotes>',
        "word/document.xml": f"<w:document {ns}><w:body>{body}</w:body></w:document>",
    })


_ODF = 'xmlns:office="urn:o" xmlns:text="urn:t" xmlns:table="urn:b" xmlns:style="urn:s" xmlns:fo="urn:f" xmlns:draw="urn:d" xmlns:presentation="urn:p" xmlns:svg="urn:v" xmlns:xlink="urn:x"'


def _odf(kind: str, body: str, styles: str = "") -> bytes:
    return archive({"mimetype": f"application/vnd.oasis.opendocument.{kind}", "content.xml": f"<office:document-content {_ODF}><office:automatic-styles>{styles}</office:automatic-styles><office:body>{body}</office:body></office:document-content>"})


def odt(key: int, name: str, amount: int) -> bytes:
    styles = '<style:style style:name="Strong"><style:text-properties fo:font-weight="bold"/></style:style><style:style style:name="Name" style:parent-style-name="Strong"/><style:style style:name="Amount"><style:text-properties fo:font-style="italic"/></style:style>'
    styles += '<text:list-style style:name="L"><text:list-level-style-number text:level="1" style:num-format="1" style:num-suffix="."/><text:list-level-style-bullet text:level="2"/></text:list-style>'
    note = f'<text:note text:note-class="footnote"><text:note-citation>1</text:note-citation><text:note-body><text:p>Counted for {key}.</text:p></text:note-body></text:note>'

    def cell(x: object) -> str:
        return f"<table:table-cell><text:p>{x}</text:p></table:table-cell>"

    body = f'<text:h text:outline-level="1">{name}</text:h><text:p>Account of <text:span text:style-name="Name">{name}</text:span> is <text:span text:style-name="Amount">{amount}</text:span>, see <text:a xlink:href="https://example.org/{key}">site</text:a>{note}.</text:p>'
    body += f'<text:list text:style-name="L"><text:list-item><text:p>one {key}</text:p><text:list><text:list-item><text:p>inner</text:p></text:list-item></text:list></text:list-item><text:list-item><text:p>two</text:p></text:list-item></text:list>'
    body += f"<table:table><table:table-row>{cell('Key')}{cell('Name')}</table:table-row><table:table-row>{cell(key)}{cell(name)}</table:table-row></table:table><text:p>End of {key}.</text:p>"
    return _odf("text", f"<office:text>{body}</office:text>", styles)


def rtf(key: int, name: str, amount: int) -> bytes:
    link = rf"""{{\field{{\*\fldinst HYPERLINK "https://example.org/{key}"}}{{\fldrslt site}}}}"""
    body = rf"\pard\outlinelevel0 {name}\par\pard Account of {{\b {name}}} is \i {amount}\i0 , see {link}{{\footnote Counted for {key}.}}.\par"
    body += rf"\pard\ls1{{\pntext 1.\tab}}one {key}\par\pard\ls1{{\pntext 2.\tab}}two\par"
    body += rf"\trowd\trhdr\cellx900\cellx1800\pard\intbl Key\cell Name\cell\row\trowd\cellx900\cellx1800\pard\intbl {key}\cell {name}\cell\row\pard End of {key}, caf\'e9 \u8364?.\par"
    return (r"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}" + body + "}").encode("ascii")


def rst(key: int, name: str, amount: int) -> bytes:
    rule = "=" * len(name)
    return f"{name}\n{rule}\n\nAccount of **{name}** is *{amount}*, see `site <https://example.org/{key}>`_.\n\n- one {key}\n- two\n\nPart\n----\n\nCode follows::\n\n    key = {key}\n\n.. note:: Counted for {key}.\n\nEnd of ``{key}``.\n".encode()


def asciidoc(key: int, name: str, amount: int) -> bytes:
    return f"= {name}\n:author: clerk {key}\n\nAccount of *{name}* is _{amount}_, see https://example.org/{key}[site].\n\n* one {key}\n** inner\n* two\n\n== Part\n\n----\nkey = {key}\n----\n\nNOTE: Counted for {key}.\n\ninclude::other.adoc[]\n\nEnd of `{key}`.\n".encode()


def doc(key: int, name: str, amount: int) -> bytes:
    text = f'{name} holds {amount}\rsee \x13 HYPERLINK "https://example.org/{key}" \x14site\x15 now\rcell {key}\x07next\x0bline\r'
    word = bytearray(1024)
    struct.pack_into("<HH", word, 0, 0xA5EC, 0xC1)
    struct.pack_into("<II", word, 24, 1024, 1024 + len(text))
    struct.pack_into("<I", word, 0x4C, len(text))
    return compound({"WordDocument": bytes(word) + text.encode("cp1252") + bytes(64), "0Table": bytes(32)})


def epub(key: int, name: str, amount: int) -> bytes:
    page = "<html><head><title>x</title></head><body><h1>{}</h1><p>{}</p></body></html>".format
    opf = f'<package xmlns:dc="urn:dc"><metadata><dc:title>Accounts {key}</dc:title></metadata><manifest><item id="z" href="last.xhtml"/><item id="a" href="text/first.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="z"/></spine></package>'
    return archive({
        "mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="book/book.opf"/></rootfiles></container>', "book/book.opf": opf,
        "book/last.xhtml": page("Last", f"End of <em>{key}</em>."), "book/text/first.xhtml": page(name, f"Account is <b>{amount}</b>."),
    })


def pdf(key: int, name: str, amount: int) -> bytes:
    def at(size: int, y: int, text: str) -> str:
        return f"BT /F1 {size} Tf 72 {y} Td ({text}) Tj ET\n"

    shown = at(24, 720, name) + at(12, 680, f"Account is {amount} now and") + at(12, 666, f"stays so for {key}.") + at(12, 620, f"End of {key}.")
    packed = zlib.compress(shown.encode("ascii"))
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>", b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F1 4 0 R >> >> >>",
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /FirstChar 32 /Widths [" + b"500 " * 95 + b"] >>", b"<< /Filter /FlateDecode /Length %d >>\nstream\n" % len(packed) + packed + b"\nendstream",
    ]
    out, places = b"%PDF-1.5\n", []
    for i, x in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i + 1, x)
    table = b"".join(b"%010d 00000 n \n" % x for x in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))


# --------------------------------------------------------------------- spreadsheets
def xlsx(key: int, name: str, amount: int) -> bytes:
    ns = 'xmlns="http://example.org/s" xmlns:r="http://example.org/r"'
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>Share</t></is></c></row>'
    data = f'<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2" s="1"><v>{40_000 + key}.25</v></c><c r="D2" s="2"><v>{key % 4 * 0.25}</v></c></row><row r="3"><c r="A3" t="b"><v>{key % 2}</v></c><c r="B3"><f>B2*2</f><v>{amount}</v></c><c r="D3" t="e"><v>#N/A</v></c></row>'
    return archive({
        "_rels/.rels": relations(("w", "officeDocument", "xl/workbook.xml")), "xl/_rels/workbook.xml.rels": relations(("one", "worksheet", "worksheets/one.xml"), ("t", "sharedStrings", "strings.xml"), ("f", "styles", "styles.xml")),
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="Accounts {key}" sheetId="1" r:id="one"/></sheets></workbook>', "xl/strings.xml": f"<sst {ns}><si><t>Name</t></si><si><r><t>Wh</t></r><r><t>en</t></r></si><si><t>{name}</t></si></sst>",
        "xl/styles.xml": f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="9"/></cellXfs></styleSheet>', "xl/worksheets/one.xml": f"<worksheet {ns}><sheetData>{head}{data}</sheetData></worksheet>",
    })


def ods(key: int, name: str, amount: int) -> bytes:
    def cell(kind: str, value: str = "", text: str = "", more: str = "") -> str:
        return f'<table:table-cell office:value-type="{kind}" {value} {more}>{f"<text:p>{text}</text:p>" if text else ""}</table:table-cell>'

    gap = '<table:table-cell table:number-columns-repeated="500"/>'
    rows = f"<table:table-row>{cell('string', text='Name')}{cell('string', text='When')}{cell('string', text='Twice', more='table:number-columns-repeated=%s2%s' % (chr(34), chr(34)))}{gap}</table:table-row>"
    rows += f"""<table:table-row>{cell("string", text=name)}{cell("date", f'office:date-value="2020-01-{key % 28 + 1:02d}"')}{cell("percentage", f'office:value="{key % 4 * 0.25}"')}{cell("time", 'office:time-value="PT1H2M3S"')}</table:table-row>"""
    rows += f"""<table:table-row>{cell("boolean", f'office:boolean-value="{"true" if key % 2 else "false"}"')}{cell("float", f'office:value="{amount}"')}{cell("string", text="wide", more='table:number-columns-spanned="2"')}<table:covered-table-cell/></table:table-row><table:table-row table:number-rows-repeated="1000000"/>"""
    return _odf("spreadsheet", f'<office:spreadsheet><table:table table:name="Accounts {key}">{rows}</table:table></office:spreadsheet>')


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file in sectors of 512 bytes; streams are padded to 4096 bytes, below which they would stand in a mini stream."""
    table: list[int] = []
    body, found = b"", {}

    def stored(data: bytes) -> int:
        nonlocal body
        first, n = len(table), -(-len(data) // 512)
        table.extend([*range(first + 1, first + n), 0xFFFFFFFE])
        body += data + bytes(n * 512 - len(data))
        return first

    for name, data in streams.items():
        data += bytes(max(0, 4096 - len(data)))
        found[name] = (stored(data), len(data))

    def entry(name: str, kind: int, first: int, size: int) -> bytes:
        raw = name.encode("utf-16-le")
        return raw + bytes(64 - len(raw)) + struct.pack("<HBBIII36xIQ", len(raw) + 2, kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF, first, size)

    directory = stored(entry("Root Entry", 5, 0xFFFFFFFE, 0) + b"".join(entry(n, 2, *x) for n, x in found.items()))
    first, sectors = len(table), 1
    while sectors * 128 < len(table) + sectors:
        sectors += 1
    table += [0xFFFFFFFD] * sectors
    fat = struct.pack(f"<{sectors * 128}I", *table, *[0xFFFFFFFF] * (sectors * 128 - len(table)))
    head = bytes.fromhex("D0CF11E0A1B11AE1") + struct.pack("<16xHHHHH6xIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, sectors, directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", *range(first, first + sectors), *[0xFFFFFFFF] * (109 - sectors)) + body + fat


def xls(key: int, name: str, amount: int) -> bytes:
    def rec(kind: int, form: str, *values: object, tail: bytes = b"") -> bytes:
        data = struct.pack("<" + form, *values) + tail
        return struct.pack("<HH", kind, len(data)) + data

    def string(s: str) -> bytes:
        return struct.pack("<HB", len(s), 0) + s.encode("latin-1")

    bof, eof = rec(0x809, "HHHHII", 0x600, 5, 0, 0, 0, 0), rec(0x0A, "")
    half = len(name) // 2  # a string that goes on in the next record
    strings = rec(0xFC, "II", 3, 3, tail=string("Name") + string("When") + struct.pack("<HB", len(name), 0) + name[:half].encode("latin-1")) + rec(0x3C, "B", 0, tail=name[half:].encode("latin-1"))
    formats = rec(0xE0, "HH16x", 0, 0) + rec(0xE0, "HH16x", 0, 14) + rec(0xE0, "HH16x", 0, 9)
    title = f"Accounts {key}".encode("latin-1")

    def book(at: int) -> bytes:
        return bof + rec(0x85, "IBBBB", at, 0, 0, len(title), 0, tail=title) + strings + formats + eof

    cells = rec(0xFD, "HHHI", 1, 0, 0, 2) + rec(0xFD, "HHHI", 0, 1, 0, 1) + rec(0xFD, "HHHI", 0, 0, 0, 0) + rec(0x203, "HHHd", 1, 1, 1, 40_000.5 + key)
    cells += rec(0x27E, "HHHI", 1, 2, 0, (key * 25) << 2 | 3) + rec(0x205, "HHHBB", 2, 0, 0, key % 2, 0) + rec(0x203, "HHHd", 2, 1, 0, amount) + rec(0x205, "HHHBB", 2, 2, 0, 0x2A, 1)
    return compound({"Workbook": book(len(book(0))) + bof + cells + eof})


def xlsb(key: int, name: str, amount: int) -> bytes:
    def rec(kind: int, form: str = "", *values: object, tail: bytes = b"") -> bytes:
        data = struct.pack("<" + form, *values) + tail
        return (bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])) + bytes([len(data)]) + data

    def string(s: str) -> bytes:
        return struct.pack("<I", len(s)) + s.encode("utf-16-le")

    sheet = rec(0, "I4x", 0) + rec(7, "III", 0, 0, 0) + rec(6, "II", 1, 0, tail=string("Amount"))
    sheet += rec(0, "I4x", 1) + rec(7, "III", 0, 0, 1) + rec(5, "IId", 1, 0, amount) + rec(0, "I4x", 2) + rec(4, "IIB", 0, 0, key % 2) + rec(3, "IIB", 1, 0, 0x07)
    return archive({
        "_rels/.rels": relations(("w", "officeDocument", "xl/workbook.bin")), "xl/_rels/workbook.bin.rels": relations(("one", "worksheet", "one.bin"), ("t", "sharedStrings", "strings.bin")),
        "xl/one.bin": sheet, "xl/strings.bin": rec(19, "B", 0, tail=string("Name")) + rec(19, "B", 0, tail=string(name)), "xl/workbook.bin": rec(156, "II", 0, 1, tail=string("one") + string(f"Accounts {key}")),
    })


# -------------------------------------------------------------------- presentations
def pptx(key: int, name: str, amount: int) -> bytes:
    ns = 'xmlns:p="http://example.org/p" xmlns:a="http://example.org/a" xmlns:r="http://example.org/r"'

    def shape(text: str, kind: str = "", props: str = "") -> str:
        holder = f'<p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr>' if kind else ""
        return f"<p:sp>{holder}<p:txBody><a:p>{props}<a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>"

    def part(tag: str, inner: str) -> str:
        return f"<p:{tag} {ns}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:{tag}>"

    return archive({
        "_rels/.rels": relations(("d", "officeDocument", "ppt/presentation.xml")), "ppt/_rels/presentation.xml.rels": relations(("second", "slide", "slides/a.xml"), ("first", "slide", "slides/b.xml")),
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="300" r:id="first"/><p:sldId id="299" r:id="second"/></p:sldIdLst></p:presentation>',
        "ppt/slides/b.xml": part("sld", shape(name, "title") + shape(f"holds {amount}", props='<a:pPr><a:buChar char="-"/></a:pPr>')), "ppt/slides/a.xml": part("sld", shape("Last", "ctrTitle") + shape(f"End of {key}.")),
        "ppt/slides/_rels/b.xml.rels": relations(("n", "notesSlide", "../notesSlides/n.xml")), "ppt/notesSlides/n.xml": part("notes", shape(f"Counted for {key}.", "body")),
    })


def odp(key: int, name: str, amount: int) -> bytes:
    def frame(kind: str, text: str) -> str:
        holder = f'presentation:class="{kind}" ' if kind else ""
        return f'<draw:frame {holder}svg:x="1cm" svg:y="2cm"><draw:text-box><text:p>{text}</text:p></draw:text-box></draw:frame>'

    pages = f'<draw:page draw:name="one">{frame("title", name)}{frame("", f"holds {amount}")}</draw:page><draw:page draw:name="two">{frame("title", "Last")}{frame("", f"End of {key}.")}</draw:page>'
    return _odf("presentation", f"<office:presentation>{pages}</office:presentation>")


def ppt(key: int, name: str, amount: int) -> bytes:
    def atom(kind: int, data: bytes) -> bytes:
        return struct.pack("<HHI", 0, kind, len(data)) + data

    def text(kind: int, s: str) -> bytes:
        return atom(3999, struct.pack("<I", kind)) + atom(4000, s.encode("utf-16-le"))

    return compound({"PowerPoint Document": text(0, name) + text(1, f"holds {amount}\rand\x0bmore") + text(0, "Last") + text(1, f"End of {key}.")})


BUILDERS: dict[str, Build] = {f.__name__: f for f in (docx, odt, rtf, rst, asciidoc, doc, epub, pdf, xlsx, ods, xls, xlsb, pptx, odp, ppt)}
