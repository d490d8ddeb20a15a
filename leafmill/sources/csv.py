"""CSV and TSV: one table, the first record its head."""

from __future__ import annotations

from collections.abc import Iterator

from leafmill.functions.limits import DEFAULT, LimitExceeded, Limits
from leafmill.functions.tree import Builder, Document, Node, Refused

#: Characters of a text from which its rows are made anew whenever they are gone over.
LARGE = 1 << 18


def records(text: str, separator: str) -> list[list[str]]:
    """A quote anywhere begins quoting; blank lines are skipped; CR, LF and CRLF end records."""
    return list(each_record(text, separator))


def each_record(text: str, separator: str) -> Iterator[list[str]]:
    row: list[str] = []
    cell: list[str] = []
    open_row = False
    i, n = 0, len(text)
    stops = '"\r\n' + separator
    while i < n:
        c = text[i]
        if c == '"':
            open_row = True
            i += 1
            while True:
                end = text.find('"', i)
                if end < 0:
                    raise Refused("csv.unterminated-quote")
                cell.append(text[i:end])
                i = end + 1
                if text[i : i + 1] != '"':
                    break
                cell.append('"')
                i += 1
        elif c == separator:
            row.append("".join(cell))
            cell = []
            open_row = True
            i += 1
        elif c in "\r\n":
            if open_row:
                row.append("".join(cell))
                yield row
            row, cell, open_row = [], [], False
            i += 2 if text[i : i + 2] == "\r\n" else 1
        else:
            j = i
            while j < n and text[j] not in stops:
                j += 1
            cell.append(text[i:j])
            open_row = True
            i = j
    if open_row:
        row.append("".join(cell))
        yield row


def read(content: bytes, name: str = "", limits: Limits = DEFAULT) -> Document:
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as e:
        raise Refused("csv.invalid-utf8") from e
    first = text.split("\n", 1)[0]
    separator = "\t" if name.lower().endswith(".tsv") or ("\t" in first and "," not in first) else ","
    out, width, section = Builder(limits), 0, None
    found = each_record(text, separator)
    try:
        for k, row in enumerate(found):
            if not k:
                width = len(row)
                out.open("table", alignments=["default"] * width)
            if k < 2:
                if k:
                    out.close()
                section = out.open("table_body" if k else "table_head")
            if len(row) != width:
                out.report("csv.ragged-row", consequence="a record's width differs from the first's", loss="structural", context=f"record {k + 1}")
            add_row(out, row)
            if k and len(text) >= LARGE:
                section.kids.clear()  # counted and found sound; Rows makes it again
    except LimitExceeded:
        for _ in found:  # a quote without an end goes before a limit
            pass
        raise
    if section is None:
        return out.doc
    if section.tag == "table_body" and len(text) >= LARGE:
        section.kids = Rows(text, separator, limits)
    out.close()
    out.close()
    return out.doc


def add_row(out: Builder, row: list[str]) -> None:
    out.open("table_row")
    for value in row:
        out.open("table_cell", alignment="default", row_span=1, col_span=1)
        out.open("plain")
        out.text(value)
        out.close()
        out.close()
    out.close()


class Rows:
    """The rows of a large table behind its head, made one at a time, since their nodes take some 70 times the space of the text.
    A node that was changed is forgotten."""

    def __init__(self, text: str, separator: str, limits: Limits):
        self.text, self.separator, self.limits = text, separator, limits

    def __iter__(self) -> Iterator[Node]:
        out = Builder(self.limits)
        for k, row in enumerate(each_record(self.text, self.separator)):
            if k:
                add_row(out, row)
                out.nodes = 0
                yield out.doc.body.pop()

    def __bool__(self) -> bool:
        return True
