"""Small files of each package format, built in code."""

import io
import struct
import zipfile
import zlib

W = 'xmlns:w="http://w" xmlns:r="http://r" xmlns:a="http://a"'
S = 'xmlns:x="http://x" xmlns:r="http://r"'
O = 'xmlns:office="o" xmlns:text="t" xmlns:table="tb" xmlns:style="s" xmlns:fo="f" xmlns:draw="d" xmlns:presentation="p" xmlns:svg="sv" xmlns:xlink="xl" xmlns:dc="dc"'  # noqa: E741
P = 'xmlns:p="http://p" xmlns:a="http://a" xmlns:r="http://r"'
PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)


def pack(parts: dict) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as f:
        for k, v in parts.items():
            f.writestr(k, v)
    return b.getvalue()


def rels(*rows: tuple) -> str:
    return '<Relationships xmlns="x">' + "".join(f'<Relationship Id="{i}" Type="http://x/{t}" Target="{g}"{" TargetMode=" + chr(34) + "External" + chr(34) if len(e) else ""}/>' for i, t, g, *e in rows) + "</Relationships>"


def docx(body: str, **more: str) -> bytes:
    return pack({
        "_rels/.rels": rels(("r1", "officeDocument", "word/document.xml")),
        "word/_rels/document.xml.rels": rels(("h1", "hyperlink", "https://example.org/", "x"), ("f", "footnotes", "footnotes.xml"), ("i1", "image", "media/a.png")),
        "word/styles.xml": f'<w:styles {W}><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:type="paragraph" w:styleId="Sub"><w:name w:val="own"/><w:basedOn w:val="H1"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
        "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="2"><w:p><w:r><w:t>Kept at the foot.</w:t></w:r></w:p></w:footnote></w:footnotes>',
        "word/media/a.png": PNG,
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
    } | more)


def run(text: str, props: str = "") -> str:
    return f'<w:r>{"<w:rPr>" + props + "</w:rPr>" if props else ""}<w:t xml:space="preserve">{text}</w:t></w:r>'


def para(inner: str, props: str = "") -> str:
    return f'<w:p>{"<w:pPr>" + props + "</w:pPr>" if props else ""}{inner}</w:p>'


def item(text: str, level: int) -> str:
    return para(run(text), f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr>')


REPORT = docx(
    para(run("Harvest"), '<w:pStyle w:val="H1"/>')
    + para(run("Weighed ") + run("ripe dry", "<w:b/><w:i/>") + run(" by one ") + '<w:hyperlink r:id="h1">' + run("link") + "</w:hyperlink>" + run(" and counted") + '<w:r><w:footnoteReference w:id="2"/></w:r>' + run("."))
    + item("barley", 0) + item("six-row", 1) + item("oats", 0)
    + "<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/></w:tblGrid><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc>" + para(run("Name")) + "</w:tc><w:tc>" + para(run("Count"))
    + '</w:tc></w:tr><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>' + para(run("one for both sides")) + "</w:tc></w:tr></w:tbl>" + para(run("what is left"))
)


def xlsx() -> bytes:
    return pack({
        "_rels/.rels": rels(("r1", "officeDocument", "xl/workbook.xml")),
        "xl/_rels/workbook.xml.rels": rels(("a", "worksheet", "worksheets/s.xml"), ("b", "sharedStrings", "ss.xml"), ("c", "styles", "st.xml")),
        "xl/ss.xml": f"<x:sst {S}><x:si><x:t>Name</x:t></x:si><x:si><x:r><x:t>ri</x:t></x:r><x:r><x:t>ch</x:t></x:r></x:si></x:sst>",
        "xl/st.xml": f'<x:styleSheet {S}><x:cellXfs><x:xf numFmtId="0"/><x:xf numFmtId="14"/><x:xf numFmtId="9"/></x:cellXfs></x:styleSheet>',
        "xl/workbook.xml": f'<x:workbook {S}><x:sheets><x:sheet name="S1" r:id="a"/></x:sheets></x:workbook>',
        "xl/worksheets/s.xml": f'<x:worksheet {S}><x:sheetData><x:row r="1"><x:c r="A1" t="s"><x:v>0</x:v></x:c><x:c r="C1"><x:v>1.50</x:v></x:c></x:row><x:row r="2"><x:c r="A2" s="1"><x:v>43831.75</x:v></x:c><x:c r="B2" s="2"><x:v>0.125</x:v></x:c><x:c r="C2" t="b"><x:f>A1</x:f><x:v>1</x:v></x:c></x:row></x:sheetData></x:worksheet>',
    })


def odf(body: str, styles: str = "", **more: bytes) -> bytes:
    return pack({"content.xml": f"<office:document-content {O}><office:automatic-styles>{styles}</office:automatic-styles><office:body>{body}</office:body></office:document-content>"} | more)


def pptx() -> bytes:
    def shape(kind: str, text: str, props: str = "") -> str:
        ph = f'<p:nvPr><p:ph type="{kind}"/></p:nvPr>' if kind else ""
        return f'<p:sp><p:nvSpPr>{ph}</p:nvSpPr><p:spPr><a:xfrm><a:off x="1" y="2"/><a:ext cx="3" cy="4"/></a:xfrm></p:spPr><p:txBody><a:p>{props}<a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'

    slide = shape("title", "Deck") + shape("", "point", '<a:pPr><a:buChar char="-"/></a:pPr>') + shape("", "plain")
    return pack({
        "_rels/.rels": rels(("r1", "officeDocument", "ppt/presentation.xml")), "ppt/_rels/presentation.xml.rels": rels(("s1", "slide", "slides/s1.xml")),
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="256" r:id="s1"/></p:sldIdLst></p:presentation>',
        "ppt/slides/s1.xml": f"<p:sld {P}><p:cSld><p:spTree>{slide}</p:spTree></p:cSld></p:sld>", "ppt/slides/_rels/s1.xml.rels": rels(("n", "notesSlide", "../notesSlides/n1.xml")),
        "ppt/notesSlides/n1.xml": f'<p:notes {P}><p:cSld><p:spTree>{shape("body", "say this")}</p:spTree></p:cSld></p:notes>',
    })


def epub(**more: str) -> bytes:
    return pack({
        "mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>',
        "OPS/p.opf": '<package xmlns:dc="dc"><metadata><dc:title>Book</dc:title></metadata><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>',
        "OPS/a.xhtml": '<html><body><h1>One</h1><p><img src="x.png" alt="pic"/></p></body></html>', "OPS/b.xhtml": "<html><body><h1>Two</h1></body></html>",
    } | more)


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file with 512-byte sectors; short streams are padded over the cutoff so that no mini stream is needed."""
    size, chains, body, fat = 512, {}, b"", []
    for name, data in streams.items():
        data = data + bytes(max(0, 4096 - len(data)))
        n = -(-len(data) // size)
        chains[name] = (len(fat), len(data))
        fat += [len(fat) + k + 1 for k in range(n - 1)] + [0xFFFFFFFE]
        body += data + bytes(n * size - len(data))

    def entry(name: str, kind: int, start: int, length: int) -> bytes:
        raw = name.encode("utf-16-le")
        return (raw + bytes(64 - len(raw)) + struct.pack("<HBB", len(raw) + 2, kind, 1) + struct.pack("<III", 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF) + bytes(36) + struct.pack("<IQ", start, length))[:128]

    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + b"".join(entry(n, 2, s, z) for n, (s, z) in chains.items())
    directory += bytes(-len(directory) % size)
    dir_at = len(fat)
    n = len(directory) // size
    fat += [len(fat) + k + 1 for k in range(n - 1)] + [0xFFFFFFFE]
    fat_at = len(fat)
    sectors = -(-(len(fat) + 4) * 4 // size)
    fat += [0xFFFFFFFD] * sectors
    raw = struct.pack(f"<{len(fat)}I", *fat)
    raw += b"\xff" * (sectors * size - len(raw))
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, sectors, dir_at, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    difat = [fat_at + k for k in range(sectors)] + [0xFFFFFFFF] * (109 - sectors)
    return head + struct.pack("<109I", *difat) + body + directory + raw


def record(kind: int, data: bytes) -> bytes:
    return struct.pack("<HH", kind, len(data)) + data


def xls() -> bytes:
    def text(s: str, wide: bool = True) -> bytes:
        return struct.pack("<HB" if wide else "<BB", len(s), 0) + s.encode("latin-1")

    bof = record(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    sst = record(0xFC, struct.pack("<II", 2, 2) + text("Name") + struct.pack("<HB", 6, 0) + b"spl") + record(0x3C, b"\x00it!")
    xf = record(0xE0, struct.pack("<HH", 0, 0) + bytes(16)) + record(0xE0, struct.pack("<HH", 0, 14) + bytes(16))

    def book(offset: int) -> bytes:
        return bof + record(0x85, struct.pack("<IBB", offset, 0, 0) + text("Sheet", False)) + sst + xf + record(0x0A, b"")

    at = len(book(0))
    cells = record(0xFD, struct.pack("<HHHI", 1, 0, 0, 1)) + record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0x203, struct.pack("<HHHd", 1, 2, 1, 44197.5)) + record(0x27E, struct.pack("<HHHI", 0, 1, 0, 250 << 2 | 3)) + record(0x205, struct.pack("<HHHBB", 1, 1, 0, 1, 0))
    formula = record(0x06, struct.pack("<HHH", 2, 0, 0) + b"\x00" * 6 + b"\xff\xff" + bytes(6)) + record(0x207, text("calc"))
    return compound({"Workbook": book(at) + bof + cells + formula + record(0x0A, b"")})


def doc(text: str, flags: int = 0) -> bytes:
    word = bytearray(1536)
    struct.pack_into("<HHHHHH", word, 0, 0xA5EC, 0xC1, 0, 0, 0, flags)
    struct.pack_into("<II", word, 24, 1024, 1024 + len(text))
    struct.pack_into("<I", word, 0x4C, len(text))
    raw = text.encode("cp1252")
    return compound({"WordDocument": bytes(word[:1024]) + raw + bytes(512), "0Table": bytes(64)})


def ppt() -> bytes:
    def atom(kind: int, data: bytes) -> bytes:
        return struct.pack("<HHI", 0, kind, len(data)) + data

    return compound({"PowerPoint Document": atom(3999, struct.pack("<I", 0)) + atom(4008, b"Title") + atom(3999, struct.pack("<I", 1)) + atom(4000, "one\rtwo\x0bmore".encode("utf-16-le")) + atom(3999, struct.pack("<I", 2)) + atom(4008, b"note")})


def xlsb() -> bytes:
    def rec(kind: int, data: bytes) -> bytes:
        head = bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])
        return head + bytes([len(data)]) + data

    def text(s: str) -> bytes:
        return struct.pack("<I", len(s)) + s.encode("utf-16-le")

    sheet = rec(0, struct.pack("<I", 0) + bytes(4)) + rec(7, struct.pack("<III", 0, 0, 0)) + rec(5, struct.pack("<IId", 1, 0, 2.5)) + rec(0, struct.pack("<I", 1) + bytes(4)) + rec(4, struct.pack("<IIB", 0, 0, 1)) + rec(6, struct.pack("<II", 1, 0) + text("in"))
    return pack({
        "_rels/.rels": rels(("r1", "officeDocument", "xl/workbook.bin")), "xl/_rels/workbook.bin.rels": rels(("a", "worksheet", "s.bin"), ("b", "sharedStrings", "ss.bin")), "xl/s.bin": sheet, "xl/ss.bin": rec(19, b"\0" + text("Name")),
        "xl/workbook.bin": rec(156, struct.pack("<II", 0, 1) + text("a") + text("B1")),
    })


def pdf(content: bytes, flate: bool = True, more: bytes = b"") -> bytes:
    c = zlib.compress(content) if flate else content
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>",
        b"<< /Length %d %s >>\nstream\n" % (len(c), b"/Filter /FlateDecode" if flate else b"") + c + b"\nendstream",
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /FirstChar 32 /Widths [" + b"500 " * 95 + b"] >>", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold /Encoding << /Differences [65 /eacute /fi] >> >>",
    ]
    out, at = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n" % i + o + b"\nendobj\n"
    x = len(out)
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % o for o in at) + b"trailer << /Size %d /Root 1 0 R /Info << /Title (Doc) >> %s>>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, more, x)
