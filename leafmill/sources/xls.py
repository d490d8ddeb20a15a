"""XLS (BIFF8)."""

from __future__ import annotations

import struct

from leafmill.functions.cells import ERRORS, MOST_COLUMNS, family, sheet, show
from leafmill.functions.limits import DEFAULT, Limits
from leafmill.functions.tree import Builder, Document, Refused
from leafmill.sources.compound import Compound

_BOF, _EOF, _CONTINUE, _SHEET, _SST, _FORMAT, _XF, _CRYPT, _EPOCH = 0x809, 0x0A, 0x3C, 0x85, 0xFC, 0x41E, 0xE0, 0x2F, 0x22
_LABELSST, _LABEL, _NUMBER, _RK, _MULRK, _BOOLERR, _FORMULA, _STRING = 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x207


def records(stream: bytes, at: int = 0):
    """(type, parts): a record's data and that of the records that continue it."""
    held = None
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        data = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == _CONTINUE and held:
            held[1].append(data)
            continue
        if held:
            yield held
        held = (kind, [data])
    if held:
        yield held


class _Text:
    """Reads strings that may be cut between records; each further part begins with a new width flag."""

    def __init__(self, parts: list[bytes], at: int = 0):
        self.parts, self.k, self.at = parts, 0, at

    def _next(self) -> None:
        while self.at >= len(self.parts[self.k]):
            self.k, self.at = self.k + 1, 0
            if self.k >= len(self.parts):
                raise ValueError("string ends early")

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            self._next()
            part = self.parts[self.k][self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            out += part
        return out

    def string(self, wide_length: bool = True) -> str:
        n = int.from_bytes(self.take(2 if wide_length else 1), "little")
        flags = self.take(1)[0]
        runs = int.from_bytes(self.take(2), "little") if flags & 8 else 0
        extra = int.from_bytes(self.take(4), "little") if flags & 4 else 0
        out = ""
        while n:
            if self.at >= len(self.parts[self.k]):
                self._next()
                flags = flags & ~1 | self.parts[self.k][0] & 1
                self.at = 1
            wide = flags & 1
            room = (len(self.parts[self.k]) - self.at) // (2 if wide else 1)
            m = min(n, room)
            if not m:
                raise ValueError("string ends early")
            raw = self.parts[self.k][self.at : self.at + m * (2 if wide else 1)]
            out += raw.decode("utf-16-le" if wide else "latin-1", "replace")
            self.at += len(raw)
            n -= m
        if runs or extra:
            self.take(4 * runs + extra)
        return out


def rk(v: int) -> float:
    x = float(v >> 2 if v < 0x80000000 else (v >> 2) - (1 << 30)) if v & 2 else struct.unpack("<d", bytes(4) + struct.pack("<I", v & 0xFFFFFFFC))[0]
    return x / 100 if v & 1 else x


def read(content: bytes, name: str = "", limits: Limits = DEFAULT) -> Document:
    box, out = Compound(content, "xls"), Builder(limits)
    stream = box.stream("Workbook") or box.stream("Book")
    if stream is None:
        raise Refused("xls.missing-workbook")
    if len(stream) < 8 or struct.unpack_from("<H", stream, 4)[0] != 0x0600:
        raise Refused("xls.unsupported-biff")
    sheets: list[tuple[str, int]] = []
    strings: list[str] = []
    custom: dict[int, str] = {}
    kinds: list[str] = []
    epoch = False
    for kind, parts in records(stream):
        d = parts[0]
        if kind == _CRYPT:
            raise Refused("xls.encryption-refused")
        if kind == _EPOCH:
            epoch = d[:2] == b"\x01\x00"
        elif kind == _SHEET and len(d) > 7 and d[5] == 0:
            sheets.append((_Text(parts, 6).string(False), struct.unpack_from("<I", d)[0]))
        elif kind == _SST:
            t = _Text(parts, 8)
            try:
                for _ in range(struct.unpack_from("<I", d, 4)[0]):
                    strings.append(t.string())
            except (ValueError, IndexError):
                out.report("xls.truncated-strings", "warning", loss="dropped")
        elif kind == _FORMAT:
            custom[struct.unpack_from("<H", d)[0]] = _Text(parts, 2).string()
        elif kind == _XF:
            kinds.append(family(struct.unpack_from("<H", d, 2)[0], custom))
        elif kind == _EOF:
            break
    missing = 0
    for title, at in sheets:
        cells: dict[tuple[int, int], dict] = {}
        pending: tuple[int, int] | None = None
        depth = 0

        def put(row: int, col: int, text: str, kind: str, formula: str | None = None) -> None:
            if col < MOST_COLUMNS:
                cells[row, col] = {"text": text, "value_type": kind, "formula": formula, "row": row}  # noqa: B023

        def numeric(row: int, col: int, style: int, x: float, formula: str | None = None) -> None:
            kind = kinds[style] if style < len(kinds) else "number"
            put(row, col, show(x, kind, None, epoch), kind, formula)

        for kind, parts in records(stream, at):
            d = parts[0]
            if kind == _BOF:
                depth += 1
            elif kind == _EOF:
                depth -= 1
                if depth <= 0:
                    break
            elif kind == _STRING and pending:
                put(*pending, _Text(parts).string(), "string", "")
                pending = None
            elif kind in (_LABELSST, _LABEL, _NUMBER, _RK, _MULRK, _BOOLERR, _FORMULA) and len(d) >= 6:
                row, col, style = struct.unpack_from("<HHH", d)
                pending = None
                if kind == _LABELSST:
                    i, = struct.unpack_from("<I", d, 6)
                    put(row, col, strings[i] if i < len(strings) else "", "string")
                elif kind == _LABEL:
                    put(row, col, _Text(parts, 6).string(), "string")
                elif kind == _NUMBER:
                    numeric(row, col, style, struct.unpack_from("<d", d, 6)[0])
                elif kind == _RK:
                    numeric(row, col, style, rk(struct.unpack_from("<I", d, 6)[0]))
                elif kind == _MULRK:
                    for k in range((len(d) - 6) // 6):
                        s, v = struct.unpack_from("<HI", d, 4 + 6 * k)
                        numeric(row, col + k, s, rk(v))
                elif kind == _BOOLERR:
                    put(row, col, ERRORS.get(d[6], "#ERR!") if d[7] else ("TRUE" if d[6] else "FALSE"), "error" if d[7] else "boolean")
                elif d[12:14] == b"\xff\xff":
                    if d[6] == 0:
                        pending = (row, col)
                    elif d[6] == 1:
                        put(row, col, "TRUE" if d[8] else "FALSE", "boolean", "")
                    elif d[6] == 2:
                        put(row, col, ERRORS.get(d[8], "#ERR!"), "error", "")
                    else:
                        missing += 1
                        put(row, col, "", "empty", "")
                else:
                    numeric(row, col, style, struct.unpack_from("<d", d, 6)[0], "")
        rows: dict[int, list[dict | None]] = {}
        for (row, col), c in sorted(cells.items()):
            line = rows.setdefault(row, [])
            line += [None] * (col - len(line))
            line.append(c)
        sheet(out, title, [rows[r] for r in sorted(rows)])
    if missing:
        out.report("xls.formula-without-cached-value", "note", loss="dropped", count=missing)
    return out.doc
