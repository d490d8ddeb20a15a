"""Plain text: paragraphs between blank lines, soft breaks within.  As a parser, and as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.limits import DEFAULT, Limits
from leafmill.functions.markdown_writer import escape
from leafmill.functions.tree import Builder, Document, Refused


def read(content: bytes, name: str = "", limits: Limits = DEFAULT) -> Document:
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as e:
        raise Refused("text.invalid-utf8") from e
    out = Builder(limits)
    for line in [*text.split("\n"), ""]:
        line = line.removesuffix("\r")
        if not line.strip(" \t"):
            if out.in_leaf:
                out.close()
            continue
        if out.in_leaf:
            out.soft_break()
        else:
            out.open("paragraph")
        out.text(line)
    return out.doc


_RUNS = re.compile(r" [ \n]+")


def written(content: bytes, name: str = "", limits: Limits = DEFAULT) -> Document:
    """What read() and render() give, without a node for each word: a run of blanks in a paragraph is a line's end if it begins with one,
    and a space otherwise.  Texts that may have more nodes than the limit are read as others are."""
    if 2 * len(content) + 2 > limits.max_nodes:
        return read(content, name, limits)
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as e:
        raise Refused("text.invalid-utf8") from e
    parts: list[str] = []
    own: list[str] = []
    for line in [*text.split("\n"), ""]:
        line = line.removesuffix("\r")
        if line.strip(" \t"):
            own.append(line)
        elif own:
            one = "\n".join(own).replace("\t", " ").replace("\r", " ")
            parts.append(escape(_RUNS.sub(" ", one).replace("\n ", "\n").strip(" \n"), True, False, True))
            own = []
    return Document(written=("\n\n".join(parts) + "\n" if parts else "", len(parts)))


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, their lines joined by newlines."""
    lines = F.regexp_replace(text, "\r(\n|$)", "$1")
    parts = F.split(lines, r"\n(?:[ \t]*(?:\n|$))+", -1)
    bare = F.transform(parts, lambda p: F.regexp_replace(p, r"^(?:[ \t]*\n)+", ""))
    return F.filter(bare, lambda p: F.length(F.btrim(p, F.lit(" \t\n"))) > 0)


def collapse(text: Column) -> Column:
    """Runs of the four ASCII blanks to one space; other blanks are text."""
    return F.btrim(F.regexp_replace(text, r"[ \t\n\r]+", " "), F.lit(" "))
