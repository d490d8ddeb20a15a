"""PDF: text with its places, projected to headings, paragraphs, tables and images in content order."""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from dataclasses import dataclass
from statistics import median

from leafmill.functions.limits import DEFAULT, Limits
from leafmill.functions.tree import Builder, Document, Refused
from leafmill.sources.pdf_objects import END, File, Lexer, Name, Op, Ref, Stream, Unsupported

_ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "ring": "̊", "cedilla": "̧", "caron": "̌", "breve": "̆", "ogonek": "̨", "macron": "̄", "hungarumlaut": "̋", "dotaccent": "̇"}
# Glyph names that no rule below gives.
_GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\",
    "bracketright": "]", "asciicircum": "^", "underscore": "_", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„",
    "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "eth": "ð",
    "thorn": "þ", "dagger": "†", "daggerdbl": "‡", "section": "§", "paragraph": "¶", "copyright": "©", "registered": "®", "trademark": "™", "degree": "°", "sterling": "£", "yen": "¥", "cent": "¢", "Euro": "€", "minus": "−",
    "multiply": "×", "divide": "÷", "plusminus": "±", "guillemotleft": "«", "guillemotright": "»", "exclamdown": "¡", "questiondown": "¿", "dotlessi": "ı", "fraction": "⁄", "periodcentered": "·",
}


def glyph(name: str) -> str:
    base = name.split(".")[0]
    if base in _GLYPHS:
        return _GLYPHS[base]
    if len(base) == 1:
        return base
    m = re.fullmatch(r"uni((?:[0-9A-Fa-f]{4})+)|u([0-9A-Fa-f]{4,6})", base)
    if m:
        h = m.group(1)
        return "".join(chr(int(h[i : i + 4], 16)) for i in range(0, len(h), 4)) if h else chr(min(int(m.group(2), 16), 0x10FFFF))
    if base[1:] in _ACCENTS and base[0].isalpha():
        return unicodedata.normalize("NFC", base[0] + _ACCENTS[base[1:]])
    return ""


def _utf16(b: bytes) -> str:
    return b.decode("utf-16-be", "replace")


class Font:
    def __init__(self, file: File, d: dict):
        self.two = d.get("Subtype") == "Type0"
        self.map: dict[int, str] = {}
        self.widths: dict[int, float] = {}
        self.default = 0.0
        self.code_bytes = 2 if self.two else 1
        name = str(file.get(d.get("BaseFont")) or "")
        self.bold = bool(re.search(r"bold|black|heavy", name, re.I))
        get = file.get
        if self.two:
            below = get((get(d.get("DescendantFonts")) or [None])[0]) or {}
            self.default = float(get(below.get("DW")) or 1000)
            w = get(below.get("W")) or []
            i = 0
            while i + 1 < len(w):
                a, b = get(w[i]), get(w[i + 1])
                if isinstance(b, list):
                    for k, x in enumerate(b):
                        self.widths[a + k] = float(get(x) or 0)
                    i += 2
                else:
                    for k in range(a, min(b, a + 65535) + 1):
                        self.widths[k] = float(get(w[i + 2]) or 0)
                    i += 3
        else:
            first = get(d.get("FirstChar")) or 0
            for k, x in enumerate(get(d.get("Widths")) or []):
                self.widths[first + k] = float(get(x) or 0)
            enc = get(d.get("Encoding"))
            kind = get(enc.get("BaseEncoding")) if isinstance(enc, dict) else enc
            codec = "mac_roman" if kind == "MacRomanEncoding" else "cp1252"
            for c in range(32, 256):
                self.map[c] = bytes([c]).decode(codec, "replace").replace("�", "")
            if isinstance(enc, dict):
                at = 0
                for x in get(enc.get("Differences")) or []:
                    x = get(x)
                    if isinstance(x, int):
                        at = x
                    elif isinstance(x, Name):
                        self.map[at] = glyph(x)
                        at += 1
        uni = get(d.get("ToUnicode"))
        if isinstance(uni, Stream):
            try:
                self.cmap(file.decode(uni))
            except (Unsupported, ValueError, zlib.error):
                pass
        self.mapped = bool(self.map) or not self.two

    def cmap(self, data: bytes) -> None:
        lexer, args = Lexer(data), []
        while True:
            x = lexer.next()
            if x is END:
                return
            if not isinstance(x, Op):
                args.append(x)
                continue
            if x == "endcodespacerange" and args and isinstance(args[0], bytes):
                self.code_bytes = len(args[0]) or self.code_bytes
            elif x == "endbfchar":
                for a, b in zip(args[::2], args[1::2], strict=False):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        self.map[int.from_bytes(a, "big")] = _utf16(b)
            elif x == "endbfrange":
                for a, z, b in zip(args[::3], args[1::3], args[2::3], strict=False):
                    if not isinstance(a, bytes) or not isinstance(z, bytes):
                        continue
                    low, high = int.from_bytes(a, "big"), int.from_bytes(z, "big")
                    for k in range(min(high - low, 65535) + 1):
                        if isinstance(b, list):
                            if k < len(b) and isinstance(b[k], bytes):
                                self.map[low + k] = _utf16(b[k])
                        elif isinstance(b, bytes) and b:
                            last = int.from_bytes(b[-2:], "big") + k
                            self.map[low + k] = _utf16(b[:-2] + (last & 0xFFFF).to_bytes(2, "big"))
            args = []

    def show(self, s: bytes):
        """(text, width in text space of size 1, is a single-byte space) of each code."""
        n = self.code_bytes
        for i in range(0, len(s) - n + 1, n):
            c = int.from_bytes(s[i : i + n], "big")
            yield self.map.get(c, "" if self.two else chr(c)), self.widths.get(c, self.default) / 1000, n == 1 and c == 32


@dataclass
class Line:
    text: str
    x: float
    y: float
    size: float
    bold: bool
    end: float
    page: int
    spans: list  # (x, text) of pieces with wide gaps between them


def _mul(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


_I = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Page:
    """Runs a page's content; gathers lines, rules and images in content order."""

    def __init__(self, file: File, out: Builder, number: int):
        self.file, self.out, self.number = file, out, number
        self.items: list = []
        self.rules: list[tuple[float, float, float, float]] = []
        self.fonts: dict[int, Font] = {}
        self.line: Line | None = None
        self.depth = 0
        self.plain = Font(file, {})  # what an unknown font is taken for
        self.height = 0.0

    def font(self, ref, d: dict) -> Font:
        key = ref[0] if isinstance(ref, Ref) else id(d)
        if key not in self.fonts:
            self.fonts[key] = Font(self.file, d)
        return self.fonts[key]

    def run(self, data: bytes, resources: dict, ctm: tuple = _I) -> None:
        get, lexer = self.file.get, Lexer(data)
        args: list = []
        stack: list = []
        tm = lm = _I
        font, size, leading, char, word, scale, rise = None, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0
        path: list = []
        start = at = (0.0, 0.0)

        def show(s: bytes) -> None:
            nonlocal tm
            if font is None:
                return
            for text, w, blank in font.show(s):
                step = (w * size + char + (word if blank else 0)) * scale
                self.glyph(text, _mul((1, 0, 0, 1, 0, rise), _mul(tm, ctm)), size, w * size * scale, font)
                tm = _mul((1, 0, 0, 1, step, 0), tm)

        while True:
            x = lexer.next()
            if x is END:
                break
            if not isinstance(x, Op):
                args.append(x)
                if len(args) > 4096:
                    args = []
                continue
            a = args
            args = []
            try:
                if x == "q":
                    stack.append((ctm, font, size, leading, char, word, scale, rise))
                elif x == "Q" and stack:
                    ctm, font, size, leading, char, word, scale, rise = stack.pop()
                elif x == "cm":
                    ctm = _mul(tuple(map(float, a[:6])), ctm)
                elif x == "BT":
                    tm = lm = _I
                elif x == "Tf":
                    fonts = get(resources.get("Font")) or {}
                    d = get(fonts.get(a[0]))
                    font, size = (self.font(fonts.get(a[0]), d) if isinstance(d, dict) else self.plain), float(a[1])
                elif x in ("Td", "TD"):
                    if x == "TD":
                        leading = -float(a[1])
                    lm = tm = _mul((1, 0, 0, 1, float(a[0]), float(a[1])), lm)
                elif x == "Tm":
                    lm = tm = tuple(map(float, a[:6]))
                elif x == "T*":
                    lm = tm = _mul((1, 0, 0, 1, 0, -leading), lm)
                elif x == "TL":
                    leading = float(a[0])
                elif x == "Tc":
                    char = float(a[0])
                elif x == "Tw":
                    word = float(a[0])
                elif x == "Tz":
                    scale = float(a[0]) / 100
                elif x == "Ts":
                    rise = float(a[0])
                elif x == "Tj":
                    show(a[0])
                elif x in ("'", '"'):
                    if x == '"':
                        word, char = float(a[0]), float(a[1])
                    lm = tm = _mul((1, 0, 0, 1, 0, -leading), lm)
                    show(a[-1])
                elif x == "TJ":
                    for p in a[0]:
                        if isinstance(p, bytes):
                            show(p)
                        else:
                            tm = _mul((1, 0, 0, 1, -float(p) / 1000 * size * scale, 0), tm)
                            if float(p) <= -180 and font is not None and not font.widths and self.line is not None:
                                self.line.text += "" if self.line.text.endswith(" ") else " "
                elif x == "Do":
                    self.object(get((get(resources.get("XObject")) or {}).get(a[0])), a[0], resources, ctm)
                elif x == "BI":
                    end = re.compile(rb"[\s]EI(?=[\s]|$)").search(data, lexer.at)
                    lexer.at = end.end() if end else len(data)
                    self.out.report("pdf.images-omitted", "note", loss="dropped")
                elif x == "m":
                    start = at = (float(a[0]), float(a[1]))
                elif x == "l":
                    path.append((*at, float(a[0]), float(a[1])))
                    at = (float(a[0]), float(a[1]))
                elif x == "h":
                    path.append((*at, *start))
                elif x == "re":
                    rx, ry, w, h = map(float, a[:4])
                    if abs(w) < 2.5 or abs(h) < 2.5:
                        path.append((rx, ry, rx + w, ry) if abs(w) >= abs(h) else (rx, ry, rx, ry + h))
                    else:
                        path += [(rx, ry, rx + w, ry), (rx, ry + h, rx + w, ry + h), (rx, ry, rx, ry + h), (rx + w, ry, rx + w, ry + h)]
                elif x in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*"):
                    for x0, y0, x1, y1 in path:
                        p, r = _mul((1, 0, 0, 1, x0, y0), ctm), _mul((1, 0, 0, 1, x1, y1), ctm)
                        if len(self.rules) < 512:
                            self.rules.append((p[4], p[5], r[4], r[5]))
                    path = []
                elif x == "n":
                    path = []
            except (IndexError, TypeError, ValueError, AttributeError):
                continue

    def glyph(self, text: str, m: tuple, size: float, width: float, font: Font) -> None:
        x, y = m[4], m[5]
        scale = (m[2] ** 2 + m[3] ** 2) ** 0.5 or 1.0
        across = (m[0] ** 2 + m[1] ** 2) ** 0.5 or 1.0
        size = abs(size) * scale
        end = x + width * across
        line = self.line
        if line is not None and abs(line.y - y) <= 0.4 * max(size, line.size) and x >= line.x - size:
            gap = x - line.end
            if gap > (0.15 if font.widths or font.default else 1.0) * size and line.text and not line.text.endswith(" ") and text != " ":
                line.text += " "
            if gap > 1.5 * size and text.strip():
                line.spans.append([x, ""])
        else:
            self.flush()
            if not text.strip():
                return
            line = self.line = Line("", x, y, size, font.bold, end, self.number, [[x, ""]])
        if not (text == " " and line.text.endswith(" ")):
            line.text += text
        last = line.spans[-1]
        if len(line.spans) == 1 or text.strip() or last[1]:
            last[1] += (" " if last[1] and line.text[-1 - len(text) :].startswith(" ") and not last[1].endswith(" ") and text != " " else "") + text
        line.end = max(end, line.end)
        line.size = max(line.size, size)

    def flush(self) -> None:
        if self.line is not None and self.line.text.strip():
            self.line.text = self.line.text.strip()
            self.items.append(self.line)
        self.line = None

    def object(self, o, name: str, resources: dict, ctm: tuple) -> None:
        if not isinstance(o, Stream):
            return
        kind = self.file.get(o.dict.get("Subtype"))
        if kind == "Form" and self.depth < 16:
            self.depth += 1
            try:
                matrix = self.file.get(o.dict.get("Matrix"))
                own = self.file.get(o.dict.get("Resources")) or resources
                self.run(self.file.decode(o), own, _mul(tuple(map(float, matrix)), ctm) if matrix else ctm)
            except Unsupported as e:
                self.out.report("pdf.unsupported-filter", "warning", loss="dropped", context=str(e))
            self.depth -= 1
        elif kind == "Image":
            self.flush()
            self.items.append(("image", str(name), o))


def _image(file: File, s: Stream) -> tuple[bytes, str] | None:
    """JPEG and JPEG 2000 as they are; 8-bit RGB and grey as PNG."""
    names = [n for n, _ in file.filters(s)]
    if names in (["DCTDecode"], ["DCT"]):
        return s.raw, "image/jpeg"
    if names == ["JPXDecode"]:
        return s.raw, "image/jp2"
    get = file.get
    w, h, bits, space = get(s.dict.get("Width")), get(s.dict.get("Height")), get(s.dict.get("BitsPerComponent")), get(s.dict.get("ColorSpace"))
    channels = {"DeviceRGB": 3, "DeviceGray": 1}.get(space if isinstance(space, str) else "")
    if bits != 8 or not channels or not w or not h:
        return None
    data = file.decode(s)
    if len(data) < w * h * channels:
        return None
    rows = b"".join(b"\0" + data[i * w * channels : (i + 1) * w * channels] for i in range(h))

    def chunk(tag: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if channels == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b""), "image/png"


def _clusters(values: list[float], near: float = 2.0) -> list[float]:
    out: list[list[float]] = []
    for v in sorted(values):
        if out and v - out[-1][-1] <= near:
            out[-1].append(v)
        else:
            out.append([v])
    return [sum(c) / len(c) for c in out]


def grid(rules: list[tuple[float, float, float, float]]) -> tuple[list[float], list[float]] | None:
    """(column edges, row edges from the top) of a ruled table: three rules each way that span it."""
    level = [(min(a, c), max(a, c), (b + d) / 2) for a, b, c, d in rules if abs(b - d) <= 2 < abs(a - c)]
    upright = [(min(b, d), max(b, d), (a + c) / 2) for a, b, c, d in rules if abs(a - c) <= 2 < abs(b - d)]
    ys, xs = _clusters([y for _, _, y in level]), _clusters([x for _, _, x in upright])
    if len(ys) < 3 or len(xs) < 3:
        return None

    def spans(lines: list[tuple[float, float, float]], at: float, low: float, high: float) -> bool:
        parts = sorted((a, b) for a, b, p in lines if abs(p - at) <= 2)
        covered, end = 0.0, low
        for a, b in parts:
            covered += max(0.0, min(b, high) - max(a, end))
            end = max(end, b)
        return covered >= 0.7 * (high - low)

    ys = [y for y in ys if spans(level, y, xs[0], xs[-1])]
    xs = [x for x in xs if spans(upright, x, ys[0], ys[-1])] if len(ys) >= 3 else []
    if len(ys) < 3 or len(xs) < 3 or (len(ys) - 1) * (len(xs) - 1) > 4096:
        return None
    return xs, ys[::-1]


def _table(out: Builder, rows: list[list[str]]) -> None:
    out.open("table", alignments=["default"] * max(map(len, rows)))
    out.open("table_body")
    for r in rows:
        out.open("table_row")
        for c in r:
            out.open("table_cell", alignment="default", row_span=1, col_span=1)
            out.open("plain")
            out.text(c)
            out.close()
            out.close()
        out.close()
    out.close()
    out.close()


def project(out: Builder, file: File, pages: list[Page]) -> None:
    sizes = [x.size for p in pages for x in p.items if isinstance(x, Line)]
    body = median(sizes) if sizes else 0.0
    paragraph: list[str] = []
    last: Line | None = None

    def heading(x: Line) -> int:
        ratio = x.size / body if body else 0
        return 1 if ratio >= 1.6 else 2 if ratio >= 1.35 else 3 if ratio >= 1.12 and x.bold else 0

    def flush() -> None:
        if not paragraph:
            return
        text = ""
        for line in paragraph:
            if text.endswith("-") and len(text) > 1 and text[-2].isalpha() and line[:1].islower():
                text = text[:-1] + line
            else:
                text += (" " if text else "") + line
        paragraph.clear()
        node = out.open("paragraph")
        out.text(text)
        out.close()
        if last is not None:
            place(node, last)

    def place(node, line: Line) -> None:
        """Where a block ends on its page, in EMU from the top left corner."""
        out.facet(node, "provenance", plugin="pdf", member=f"page-{line.page + 1}", byte_start=0, byte_len=0, confidence="projected")
        out.facet(node, "layout", surface="page", surface_index=line.page, x=round(line.x * 12700), y=round((pages[line.page].height - line.y - line.size) * 12700))

    for p in pages:
        found = grid(p.rules)
        inside: set[int] = set()
        table: list[list[str]] = []
        if found:
            xs, ys = found
            table = [[""] * (len(xs) - 1) for _ in ys[1:]]
            for k, x in enumerate(p.items):
                if not isinstance(x, Line) or not (xs[0] - 2 <= x.x <= xs[-1] and ys[-1] - 2 <= x.y <= ys[0]):
                    continue
                row = next((r for r in range(len(ys) - 1) if ys[r + 1] - 2 <= x.y <= ys[r]), None)
                if row is None:
                    continue
                for sx, text in x.spans:
                    col = max((c for c in range(len(xs) - 1) if xs[c] - 2 <= sx), default=0)
                    table[row][col] = (table[row][col] + " " + text.strip()).strip()
                inside.add(k)
            if len(inside) < 2:
                inside = set()
        k = 0
        while k < len(p.items):
            x = p.items[k]
            if k in inside:
                if k == min(inside):
                    flush()
                    _table(out, table)
                k += 1
                last = None
                continue
            if not isinstance(x, Line):
                flush()
                last = None
                _emit_image(out, file, x[1], x[2])
                k += 1
                continue
            run = _columns(p.items, k, inside)
            if run:
                flush()
                last = None
                _table(out, run)
                k += len(run)
                continue
            level = heading(x)
            if level:
                flush()
                node = out.open("heading", level=level)
                out.text(x.text)
                out.close()
                place(node, x)
                last = None
            else:
                if last is not None and (x.page != last.page or last.y - x.y > 1.7 * max(x.size, last.size) or x.y > last.y + x.size):
                    flush()
                paragraph.append(x.text)
                last = x
            k += 1
        flush()
        last = None


def _columns(items: list, k: int, inside: set[int]) -> list[list[str]] | None:
    """Three lines or more with the same two or more columns."""
    first = items[k]
    starts = [s for s, t in first.spans if t.strip()]
    if len(starts) < 2:
        return None
    rows: list[list[str]] = []
    for i in range(k, len(items)):
        x = items[i]
        if not isinstance(x, Line) or i in inside or x.page != first.page:
            break
        spans = [(s, t.strip()) for s, t in x.spans if t.strip()]
        if len(spans) < 2 or len(spans) > len(starts) or any(min(abs(s - c) for c in starts) > 0.8 * x.size for s, _ in spans):
            break
        row = [""] * len(starts)
        for s, t in spans:
            row[min(range(len(starts)), key=lambda c: abs(starts[c] - s))] = t
        rows.append(row)
    return rows if len(rows) >= 3 else None


def _emit_image(out: Builder, file: File, name: str, s: Stream) -> None:
    try:
        got = _image(file, s)
    except (Unsupported, ValueError, zlib.error):
        got = None
    if got is None:
        out.report("pdf.images-omitted", "note", loss="dropped", context=name)
        return
    known = next((i for i, r in enumerate(out.doc.resources) if r["content"] == got[0]), None)  # drawn again
    n = out.resource(f"pdf-image-{len(out.doc.resources) + 1}", *got) if known is None else known
    out.open("paragraph")
    out.begin("image", url=out.doc.resources[n]["source"], title="", resource=n)
    out.end()
    out.close()


def _text(b) -> str:
    if not isinstance(b, bytes):
        return ""
    return b[2:].decode("utf-16-be", "replace") if b[:2] == b"\xfe\xff" else b.decode("cp1252", "replace")


def read(content: bytes, name: str = "", limits: Limits = DEFAULT) -> Document:
    if b"%PDF" not in content[:1024]:
        raise Refused("pdf.not-pdf")
    file, out = File(content, limits), Builder(limits)
    get = file.get
    out.report("pdf.layout-projection", "note", loss="presentation")
    info = get(file.trailer.get("Info"))
    for key, field in (("title", "Title"), ("author", "Author"), ("subject", "Subject")):
        text = _text(get(info.get(field))).strip() if isinstance(info, dict) else ""
        if text:
            out.meta(key, text)
    pages: list[Page] = []
    todo = [(get(file.trailer["Root"]).get("Pages"), {})]
    seen: set = set()
    links = 0
    while todo:
        ref, inherited = todo.pop()
        if isinstance(ref, Ref):
            if ref in seen:
                continue
            seen.add(ref)
        d = get(ref)
        if not isinstance(d, dict):
            continue
        own = inherited | {k: d[k] for k in ("Resources", "MediaBox") if k in d}
        if "Kids" in d:
            todo += [(k, own) for k in reversed(get(d["Kids"]) or [])]
            continue
        page = Page(file, out, len(pages))
        box = [get(x) for x in get(own.get("MediaBox")) or []]
        page.height = float(box[3]) - float(box[1]) if len(box) == 4 and all(isinstance(x, (int, float)) for x in box) else 792.0
        contents = get(d.get("Contents"))
        parts = []
        for c in contents if isinstance(contents, list) else [contents]:
            c = get(c)
            if isinstance(c, Stream):
                try:
                    parts.append(file.decode(c))
                except Unsupported as e:
                    out.report("pdf.unsupported-filter", "warning", loss="dropped", context=str(e))
                except (ValueError, zlib.error):
                    out.report("pdf.corrupt-stream", "warning", loss="dropped")
        page.run(b"\n".join(parts), get(own.get("Resources")) or {})
        page.flush()
        pages.append(page)
        links += sum(1 for a in get(d.get("Annots")) or [] if isinstance(get(a), dict) and get(get(a).get("Subtype")) == "Link")
    if links:
        out.report("pdf.links-omitted", "note", loss="structural", count=links)
    if not any(isinstance(x, Line) for p in pages for x in p.items):
        out.report("pdf.no-text", "warning", loss="dropped")
    project(out, file, pages)
    return out.doc
