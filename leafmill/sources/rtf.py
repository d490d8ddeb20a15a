"""RTF: groups, destinations and control words; text is Windows-1252 whatever the file declares."""

from __future__ import annotations

import re

from leafmill.functions.limits import DEFAULT, LimitExceeded, Limits
from leafmill.functions.runs import Lists, Runs
from leafmill.functions.tree import Builder, Document, Refused

_TOKEN = re.compile(rb"\\([a-zA-Z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z'])|([{}])|([^\\{}\r\n]+)|[\r\n]+|\\")
_SKIPPED = frozenset("fonttbl colortbl info generator listtable listoverridetable rsidtbl themedata colorschememapping datastore latentstyles xmlnstbl header headerl headerr headerf footer footerl footerr footerf filetbl revtbl pgptbl mmathPr wgrffmtfilter xe tc bkmkstart bkmkend nonshppict shptxt datafield formfield".split())
_SYMBOLS = {"emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "emspace": " ", "enspace": " ", "qmspace": " "}
_STYLES = {"b": "strong", "i": "emphasis", "strike": "strikethrough", "striked": "strikethrough", "scaps": "small_caps", "ul": "underline", "super": "superscript", "sub": "subscript"}
_SILENT = re.compile(r"(?:f|fs|cf|cb|li|ri|fi|sa|sb|sl|slmult|lang\w*|deff\w*|ansi\w*|rtf|uc|q[lrcj]|widctlpar|nowidctlpar|hyphpar|keepn?|cs|s|ds|ts|af\w*|hich|loch|dbch|ltrch|rtlch|ltrpar|rtlpar|pard|sect\w*|pg\w*|marg\w*|paper\w*|view\w*|tx|tq\w*|kerning|expnd\w*|charscalex|noproof|insrsid|char\w*|rsid\w*|itap|cl\w+|tr\w+|cellx|intbl|nestrow|brdr\w*|b?rd\w*|u[lp]\w*|outlinelevel|ls|ilvl|pn\w*|mac|pc|pca|fet|ftn\w*|aftn\w*|chftn|lytprtmet|hyph\w*|form\w*|dn|up|v|shad|outl|caps|chpgn|pict\w*|pic\w+|blip\w*|wmetafile|pngblip|jpegblip|emfblip|bin|adjustright|aspalpha|aspnum|faauto|contextualspacing|nosupersub|f\w+|deflang\w*|jexpand|viewkind|viewscale|nouicompat|stshf\w*|gutter|htmautsp|noqfpromote|lquote|softline|no\w+|wp\w*|sp\w+|ql|line|page|tab|par)$")


class _State:
    __slots__ = ("dest", "hidden", "styles", "uc", "url")

    def __init__(self, other: _State | None = None):
        self.dest = other.dest if other else "text"
        self.styles = set(other.styles) if other else set()
        self.uc = other.uc if other else 1
        self.hidden = other.hidden if other else False
        self.url = False


class _Reader:
    def __init__(self, content: bytes, limits: Limits):
        self.s, self.limits, self.out = content, limits, Builder(limits)
        self.runs, self.lists = Runs(self.out), Lists(self.out)
        self.state, self.stack = _State(), []
        self.skip = 0
        self.reset_paragraph()
        self.row: dict | None = None
        self.table_open: str | None = None
        self.instruction = ""
        self.marker = ""
        self.unknown: set[str] = set()
        self.star = False
        self.at_depth: list[tuple[int, str]] = []
        self.style_names: dict[int, str] = {}
        self.naming: int | None = None

    def reset_paragraph(self) -> None:
        self.level, self.outline, self.list_level, self.list_id, self.ordered, self.in_table, self.style = None, None, 0, None, None, False, 0

    # ------------------------------------------------------------- output
    def ensure(self) -> None:
        if self.out.in_leaf:
            return
        if self.row is not None and self.in_table:
            if not self.row["cell"]:
                self.begin_cell()
            self.styled(self.out.open("paragraph"))
            return
        self.end_table()
        if self.list_id is not None:
            ordered = self.ordered if self.ordered is not None else bool(re.match(r"\s*\(?\d", self.marker))
            self.lists.item(self.list_level, self.list_id, ordered)
            self.styled(self.out.open("paragraph"))
        elif self.outline is not None and self.outline < 9:
            self.lists.end()
            self.styled(self.out.open("heading", level=min(self.outline + 1, 6)))
        else:
            self.lists.end()
            self.styled(self.out.open("paragraph"))
        self.marker = ""

    def styled(self, node) -> None:
        if self.style and self.style_names.get(self.style):
            self.out.facet(node, "style", name=self.style_names[self.style])

    def text(self, s: str) -> None:
        if self.skip:
            n = min(self.skip, len(s))
            self.skip -= n
            s = s[n:]
        if not s:
            return
        d = self.state.dest
        if d == "text":
            if self.state.hidden:
                return
            if not s.strip(" \t") and not self.out.in_leaf:
                return
            self.ensure()
            self.runs.text(s, self.state.styles)
        elif d == "instruction":
            self.instruction += s
        elif d == "styles" and self.naming is not None:
            name = self.style_names.get(self.naming, "") + s
            self.style_names[self.naming] = name.split(";")[0].strip()
            self.naming = None if ";" in name else self.naming
        elif d == "marker":
            self.marker += s

    def end_paragraph(self) -> None:
        self.runs.end()
        if self.out.in_leaf:
            node = self.out.close()
            if not node.kids:
                self.out.blocks[-1][1].pop()

    # -------------------------------------------------------------- tables
    def begin_cell(self) -> None:
        self.open_row()
        self.out.open("table_cell", alignment="default", row_span=1, col_span=1)
        self.row["cell"] = True

    def open_row(self) -> None:
        r = self.row
        if r["open"]:
            return
        self.lists.end()
        section = "table_head" if r["head"] and self.table_open in (None, "table_head") else "table_body"
        if self.table_open is None:
            self.out.open("table", alignments=["default"] * max(1, r["columns"]))
            self.out.open(section)
        elif self.table_open != section:
            self.out.close()
            self.out.open(section)
        self.table_open = section
        self.out.open("table_row")
        r["open"] = True

    def end_cell(self) -> None:
        if self.row is None:
            self.row = {"columns": 1, "head": False, "open": False, "cell": False}
        self.end_paragraph()
        if not self.row["cell"]:
            self.begin_cell()
        self.out.close()
        self.row["cell"] = False

    def end_row(self) -> None:
        if self.row is None:
            return
        self.end_paragraph()
        if self.row["cell"]:
            self.out.close()
        if self.row["open"]:
            self.out.close()
        self.row["open"] = self.row["cell"] = False

    def end_table(self) -> None:
        if self.table_open is None:
            return
        self.end_row()
        self.out.close()
        self.out.close()
        self.table_open = None
        self.row = None

    # ---------------------------------------------------------------- loop
    def read(self) -> Document:
        s, n, at = self.s, len(self.s), 0
        while at < n:
            m = _TOKEN.match(s, at)
            if m is None:
                at += 1
                continue
            at = m.end()
            word, value, hexa, symbol, brace, text = m.groups()
            if brace == b"{":
                if len(self.stack) >= self.limits.max_depth:
                    raise LimitExceeded("max_depth")
                self.stack.append(self.state)
                self.state = _State(self.state)
                self.skip = 0
                self.star = False
            elif brace == b"}":
                self.skip = 0
                self.close_group()
                if not self.stack:
                    break
                self.state = self.stack.pop()
            elif text is not None:
                self.text(text.decode("cp1252", "replace"))
            elif hexa is not None:
                self.text(bytes([int(hexa, 16)]).decode("cp1252", "replace"))
            elif symbol is not None:
                self.symbol(symbol)
            elif word is not None:
                v = None if value is None else int(value)
                if word == b"bin" and v:
                    at += v
                else:
                    self.word(word.decode(), v)
        self.end_paragraph()
        self.end_table()
        self.lists.end()
        return self.out.doc

    def symbol(self, c: bytes) -> None:
        if c == b"*":
            self.star = True
        elif c in (b"\\", b"{", b"}"):
            self.text(c.decode())
        elif c == b"~":
            self.text(" ")
        elif c == b"_":
            self.text("‑")
        elif c in (b"\r", b"\n"):
            self.word("par", None)

    def close_group(self) -> None:
        if self.state.url:
            self.runs.end()
            self.out.end()
        if self.at_depth and self.at_depth[-1][0] == len(self.stack):
            _, kind = self.at_depth.pop()
            if kind == "note":
                self.end_note()

    def word(self, w: str, v: int | None) -> None:
        st = self.state
        starred, self.star = self.star, False
        if w == "u" and v is not None:
            self.skip = 0
            code = v + 65536 if v < 0 else v
            self.text(chr(code) if not 0xD800 <= code < 0xE000 else "�")
            self.skip = st.uc
            return
        self.skip = 0
        if w == "uc":
            st.uc = max(v or 0, 0)
        elif w in _SKIPPED:
            st.dest = "skip"
        elif w == "stylesheet":
            st.dest = "styles"
        elif st.dest == "styles":
            if starred:
                st.dest = "skip"
            elif w == "s":
                self.naming = v or 0
                self.style_names.pop(self.naming, None)
        elif w == "object":
            st.dest = "skip"
            self.out.report("rtf.objects-dropped", "note", loss="dropped")
        elif w == "footnote":
            self.begin_note()
        elif w == "fldinst":
            st.dest, self.instruction = "instruction", ""
        elif w == "fldrslt":
            st.dest = "text"
            m = re.match(r'\s*HYPERLINK\s+(?:(\\l)\s+)?"?([^"\s]+)"?', self.instruction)
            if m:
                self.ensure()
                self.runs.end()
                self.out.begin("link", url=("#" if m.group(1) else "") + m.group(2), title="")
                st.url = True
            self.instruction = ""
        elif w in ("pntext", "listtext"):
            st.dest, self.marker = "marker", ""
        elif w == "pict":
            st.dest = "skip"
            self.out.report("rtf.images-dropped", "note", loss="dropped")
        elif w in ("shppict", "pn", "field", "upr", "ud", "shp", "shpinst", "rtf"):
            if w == "pn":
                st.dest = "marker"
        elif starred and st.dest == "text" and w not in ("shppict",):
            st.dest = "skip"
        elif st.dest not in ("text", "marker"):
            return
        elif w in ("pnlvlbody", "pndec", "pnlcltr", "pnucltr", "pnlcrm", "pnucrm"):
            self.ordered, self.list_id = True, self.list_id or "pn"
        elif w == "pnlvlblt":
            self.ordered, self.list_id = False, self.list_id or "pn"
        elif st.dest == "marker":
            if w == "tab":
                self.marker += " "
        elif w in ("par", "sect"):
            self.end_paragraph()
        elif w == "pard":
            if not self.out.in_leaf:
                self.reset_paragraph()
        elif w == "plain":
            st.styles = set()
        elif w in _STYLES:
            if v == 0:
                st.styles.discard(_STYLES[w])
            else:
                st.styles.add(_STYLES[w])
        elif w in ("ulnone", "nosupersub"):
            st.styles -= {"underline"} if w == "ulnone" else {"superscript", "subscript"}
        elif w == "v":
            st.hidden = v != 0
        elif w == "line":
            self.ensure()
            self.runs.style(st.styles)
            self.out.hard_break()
        elif w == "tab":
            if self.out.in_leaf:
                self.runs.style(st.styles)
                self.out.space()
        elif w == "page":
            self.out.report("rtf.page-break-dropped", "note", loss="presentation")
        elif w in _SYMBOLS:
            self.text(_SYMBOLS[w])
        elif w == "outlinelevel":
            self.outline = v
        elif w == "s":
            self.style = v or 0
        elif w == "ls":
            self.list_id = v
        elif w == "ilvl":
            self.list_level = v or 0
        elif w == "trowd":
            self.end_paragraph()
            if self.row is not None and not self.row["open"]:
                self.row.update(columns=0, head=False)
            elif self.row is None:
                self.row = {"columns": 0, "head": False, "open": False, "cell": False}
        elif w == "cellx" and self.row is not None:
            self.row["columns"] += 1
        elif w == "trhdr" and self.row is not None:
            self.row["head"] = True
        elif w == "intbl":
            self.in_table = True
        elif w == "cell":
            self.end_cell()
        elif w == "row":
            self.end_row()
            self.in_table = False
        elif w in ("nestcell", "nestrow", "itap") and w != "itap":
            self.out.report("rtf.nested-table-flattened", "note", loss="structural")
        elif not _SILENT.match(w) and w not in self.unknown:
            self.unknown.add(w)
            self.out.report("rtf.unknown-control-words", "note", context=w)

    def begin_note(self) -> None:
        self.ensure()
        self.runs.end()
        self._kept = getattr(self, "_kept", [])
        self._kept.append((self.runs, self.lists, self.row, self.table_open, self.level, self.outline, self.list_level, self.list_id, self.ordered, self.in_table, self.out.note()))
        self.runs, self.lists, self.row, self.table_open = Runs(self.out), Lists(self.out), None, None
        self.reset_paragraph()
        self.state.styles = set()
        self.at_depth.append((len(self.stack), "note"))

    def end_note(self) -> None:
        self.end_paragraph()
        self.end_table()
        self.lists.end()
        self.out.end_note()
        self.runs, self.lists, self.row, self.table_open, self.level, self.outline, self.list_level, self.list_id, self.ordered, self.in_table, n = self._kept.pop()
        self.out.inline("note", note=n)


def read(content: bytes, name: str = "", limits: Limits = DEFAULT) -> Document:
    if not content.startswith(b"{\\rtf"):
        raise Refused("rtf.not-rtf")
    return _Reader(content, limits).read()
