"""Format detection as column expressions: magic bytes, member names, extensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format -> extensions.
EXTENSIONS = {
    "text": ["txt", "text"], "markdown": ["md", "markdown"], "csv": ["csv", "tsv"], "docx": ["docx", "docm"], "rtf": ["rtf"], "xlsx": ["xlsx", "xlsm"], "odt": ["odt"], "pptx": ["pptx", "pptm", "ppsx", "ppsm"], "html": ["html", "htm"],
    "asciidoc": ["adoc", "asciidoc"], "rst": ["rst"], "ods": ["ods"], "odp": ["odp"], "epub": ["epub"], "pdf": ["pdf"], "doc": ["doc"], "xls": ["xls"], "ppt": ["ppt", "pps", "pot"], "xlsb": ["xlsb"],
}
#: Names to look for in a ZIP, first match wins.
_ZIP = [("docx", b"word/document"), ("xlsb", b"xl/workbook.bin"), ("xlsx", b"xl/workbook"), ("pptx", b"ppt/presentation"), ("epub", b"application/epub+zip"), ("odt", b"application/vnd.oasis.opendocument.text"), ("ods", b"application/vnd.oasis.opendocument.spreadsheet"), ("odp", b"application/vnd.oasis.opendocument.presentation")]
_CFB = [("doc", "WordDocument"), ("ppt", "PowerPoint Document"), ("xls", "Workbook"), ("xls", "Book")]
_CFB_MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")


def _bytes(b: bytes) -> Column:
    return F.lit(bytearray(b))


def sniff(content: Column) -> Column:
    """The format that the bytes show, 'zip' for other archives, null if they show none."""
    archive = F.when(F.lit(False), F.lit(""))
    for name, magic in _ZIP:
        archive = archive.when(F.contains(content, _bytes(magic)), F.lit(name))
    compound = F.when(F.lit(False), F.lit(""))
    for name, stream in _CFB:
        compound = compound.when(F.contains(content, _bytes(stream.encode("utf-16-le"))), F.lit(name))
    return (
        F.when(F.startswith(content, _bytes(b"PK\x03\x04")), archive.otherwise(F.lit("zip")))
        .when(F.startswith(content, _bytes(_CFB_MAGIC)), compound.otherwise(F.lit("doc")))
        .when(F.startswith(content, _bytes(b"{\\rtf")), F.lit("rtf"))
        .when(F.startswith(content, _bytes(b"%PDF")), F.lit("pdf"))
    )


def extension(name: Column) -> Column:
    last = F.regexp_extract(F.element_at(F.split(name, r"[/\\]", -1), -1), r"\.([^.]+)$", 1)
    return F.when(F.length(last) > 0, F.lower(last))


def by_extension(name: Column) -> Column:
    ext = extension(name)
    out = F.when(F.lit(False), F.lit(""))
    for fmt, exts in EXTENSIONS.items():
        out = out.when(ext.isin(*exts), F.lit(fmt))
    return out


def resolve(name: Column, content: Column, declared: Column | None = None, from_file: bool = False) -> tuple[Column, Column]:
    """(format, report code or null).  A declared format wins.  For a file a known extension is taken as it is; otherwise
    content beats extension, except that a bare ZIP loses to it."""
    ext, seen = by_extension(name), sniff(content)
    declared = F.lit(None).cast("string") if declared is None else declared
    own = F.when(seen == "zip", F.coalesce(ext, F.lit("docx"))).otherwise(F.coalesce(seen, ext))
    fmt = F.coalesce(declared, F.coalesce(ext, own) if from_file else own)
    differs = F.lit(False) if from_file else declared.isNull() & ext.isNotNull() & seen.isNotNull() & (seen != "zip") & (seen != ext)
    code = F.when(fmt.isNull(), F.lit("core.undetectable-input-format")).when(differs, F.lit("core.extension-mismatch"))
    return fmt, code


def suggestion(name: Column) -> Column:
    """The first of the closest format names within two edits, for a name that is none."""
    known = F.array(*[F.struct(F.levenshtein(F.lower(name), F.lit(f)).alias("d"), F.lit(i).alias("i"), F.lit(f).alias("f")) for i, f in enumerate(EXTENSIONS)])
    best = F.array_min(known)
    return F.when(best["d"] <= 2, best["f"])
