"""The readers by format."""

from __future__ import annotations

from leafmill.sources import asciidoc, csv, doc, docx, epub, html, markdown, odf, pdf, ppt, pptx, rst, rtf, text, xls, xlsb, xlsx

READERS = {
    "text": text.read, "markdown": markdown.read, "csv": csv.read, "docx": docx.read, "rtf": rtf.read, "xlsx": xlsx.read, "odt": odf.read_odt, "pptx": pptx.read, "html": html.read, "asciidoc": asciidoc.read, "rst": rst.read,
    "ods": odf.read_ods, "odp": odf.read_odp, "epub": epub.read, "pdf": pdf.read, "doc": doc.read, "xls": xls.read, "ppt": ppt.read, "xlsb": xlsb.read,
}
