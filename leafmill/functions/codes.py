"""The report codes: what each says, by format.  They are interface; texts of reports may change."""

from __future__ import annotations

_PACKAGE = {
    "not-an-archive": "the bytes are no readable ZIP", "hostile-archive": "a member name leaves the package", "encrypted": "the package is encrypted", "unsupported-compression": "a member is packed in a way other than stored or deflate",
    "doctype-refused": "an XML part declares a document type", "malformed-xml": "an XML part does not parse",
}
CODES: dict[str, str] = {
    "core.undetectable-input-format": "neither name nor bytes tell the format", "core.extension-mismatch": "the bytes show another format than the name", "core.unknown-input-format": "no reader has this format", "core.malformed-input": "a reader met bytes that it cannot make sense of",
    "core.input-too-large": "the input passes its limit", "core.depth-limit-exceeded": "nesting passes its limit", "core.limit-exceeded": "another limit is passed", "core.output-too-large": "the artifact passes its limit", "core.strict-refused": "more would be lost than the grade allows",
    "core.nested-table-flattened": "tables in cells became placeholders", "core.reports-truncated": "more groups of reports than are kept", "core.stale-or-invalid-manifest": "a manifest beside the input was ignored", "core.filter-broke-document": "a filter left a tree that breaks the model", "core.destination-exists": "an output exists and may not be replaced",
    "asciidoc.include-refused": "an include was left out", "asciidoc.invalid-utf8": "not UTF-8", "csv.invalid-utf8": "not UTF-8", "csv.ragged-row": "a record is wider or narrower than the first", "csv.unterminated-quote": "a quote never ends",
    "doc.not-a-compound-file": "no compound file", "doc.malformed-container": "broken sector chains", "doc.truncated": "the file ends early", "doc.missing-word-stream": "no text stream", "doc.unsupported-version": "another version of the format", "doc.encryption-refused": "encrypted", "doc.styles-omitted": "no style information", "doc.tables-flattened": "cells became paragraphs", "doc.page-breaks-dropped": "page breaks", "doc.embedded-objects-dropped": "objects",
    "docx.missing-document-part": "no main part", "docx.unhandled-construct": "an element was looked through", "docx.merged-cells-degraded": "merged cells", "docx.page-breaks-dropped": "page breaks", "docx.section-properties-dropped": "page geometry", "docx.comments-dropped": "comments", "docx.tracked-deletions-dropped": "deleted text", "docx.text-boxes-dropped": "text boxes", "docx.embedded-objects-dropped": "objects", "docx.bookmarks-dropped": "bookmarks", "docx.heading-level-clamped": "levels over six",
    "epub.bad-archive": "the bytes are no readable ZIP", "epub.drm-refused": "protected", "epub.missing-container": "no container entry", "epub.missing-package": "no package document", "epub.missing-chapter": "a chapter's file is missing", "epub.skipped-spine-item": "a spine entry cannot be read",
    "html.invalid-utf8": "not UTF-8", "html.too-deep": "nesting passes its limit", "html.skipped-embedded-content": "embedded content was left out", "markdown.invalid-utf8": "not UTF-8", "markdown.style-dropped": "a style without a mark", "markdown.extension-fallback": "an extension's fallback was written", "markdown.citation-dropped": "a citation", "markdown.raw-dropped": "raw content of another format",
    "markdown.nested-table-dropped": "a table in a cell", "markdown.table-cell-flattened": "blocks of a cell on one line", "markdown.cell-span-degraded": "a cell over rows or columns", "markdown.list-number-style-degraded": "letters or Roman numbers", "markdown.definition-list-degraded": "definitions", "markdown.container-attributes-dropped": "a container's attributes", "markdown.table-caption-degraded": "a caption became a paragraph",
    "odp.presentation-projection": "slides became a flow", "ods.formula-without-cached-value": "a formula without its value",
    "pdf.not-pdf": "no PDF header", "pdf.malformed": "no catalog", "pdf.limit": "nesting passes its limit", "pdf.encryption-refused": "encrypted", "pdf.unsupported-filter": "a stream's filter", "pdf.corrupt-stream": "a stream does not inflate", "pdf.layout-projection": "places became a flow", "pdf.images-omitted": "images in other encodings", "pdf.links-omitted": "links", "pdf.no-text": "no text at all",
    "ppt.not-a-compound-file": "no compound file", "ppt.malformed-container": "broken sector chains", "ppt.truncated": "the file ends early", "ppt.missing-document-stream": "no document stream", "ppt.encryption-refused": "encrypted", "ppt.presentation-projection": "slides became a flow",
    "pptx.missing-presentation": "no main part", "pptx.presentation-projection": "slides became a flow", "pptx.merged-cells": "merged cells", "pptx.graphic-dropped": "a chart or diagram", "rst.include-refused": "an include was left out", "rst.invalid-utf8": "not UTF-8",
    "rtf.not-rtf": "no RTF header", "rtf.page-break-dropped": "page breaks", "rtf.images-dropped": "pictures", "rtf.objects-dropped": "objects", "rtf.nested-table-flattened": "a table in a cell", "rtf.unknown-control-words": "a control word without meaning here", "text.invalid-utf8": "not UTF-8",
    "xls.not-a-compound-file": "no compound file", "xls.malformed-container": "broken sector chains", "xls.truncated": "the file ends early", "xls.missing-workbook": "no workbook stream", "xls.unsupported-biff": "older than BIFF8", "xls.encryption-refused": "encrypted", "xls.truncated-strings": "the string table ends early", "xls.formula-without-cached-value": "a formula without its value",
    "xlsb.missing-workbook": "no workbook part", "xlsb.sheets-unreadable": "no sheet can be read", "xlsb.sheet-skipped": "a sheet cannot be read", "xlsx.missing-workbook": "no workbook part", "xlsx.malformed-sheet": "a sheet does not parse", "xlsx.formula-without-cached-value": "a formula without its value",
}
for _f in ("odt", "ods", "odp"):
    CODES |= {f"{_f}.missing-content": "no content part", f"{_f}.annotations-dropped": "annotations", f"{_f}.frame-dropped": "a frame without a picture", f"{_f}.tracked-changes-dropped": "tracked changes"}
for _f in ("docx", "xlsx", "xlsb", "pptx", "odt", "ods", "odp", "epub"):
    CODES |= {f"{_f}.{k}": v for k, v in _PACKAGE.items() if f"{_f}.{k}" not in CODES}


def table(spark):
    """(code, format, meaning)."""
    return spark.createDataFrame([(c, c.split(".")[0], m) for c, m in sorted(CODES.items())], "code string, format string, meaning string")
