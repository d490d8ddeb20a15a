"""A query for each reader of a package, binary or markup format: every supplier as a document of that format, read and written
as Markdown; and SQL that puts the same Markdown together from the supplier's fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.convert import Engine, spread
from leafmill.plans.compose import BUILDERS, composed

Query = Callable[[SparkSession, str], DataFrame]
ENGINE = Engine()
#: Formats that only a name can tell; the others are told by their bytes.
NAMES = {"rst": "account.rst", "asciidoc": "account.adoc"}


def told(reports: str = "reports") -> F.Column:
    """Codes and counts of a conversion's reports, in one line."""
    return F.array_join(F.array_sort(F.transform(reports, lambda r: F.concat(r["code"], F.lit(":"), r["count"].cast("string")))), ",")


def read(fmt: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal"))
        docs = composed(rows, BUILDERS[fmt], F.col("s_suppkey"), F.col("s_name"), F.floor("s_acctbal"))
        out = ENGINE.convert(docs, F.lit(NAMES.get(fmt, "account")))
        return out.select(F.col("doc_id").alias("s_suppkey"), "format", "status", "markdown", told().alias("codes"))

    query.__name__ = f"read_{fmt}"
    return query


K, A = "CAST(s_suppkey AS VARCHAR)", "CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR)"
#: An amount that begins a cell or a line: its sign would begin a list.
_CELL = f"replace({A}, '-', '\\-')"
_SHARE = "CASE s_suppkey % 4 WHEN 0 THEN '0%' WHEN 1 THEN '25%' WHEN 2 THEN '50%' ELSE '75%' END"
_FLAG = "CASE s_suppkey % 2 WHEN 1 THEN 'TRUE' ELSE 'FALSE' END"
_DAY = "CAST(DATE '1899-12-30' + CAST(40000 + s_suppkey AS INT) AS VARCHAR)"


def _text(*parts: str) -> str:
    """Parts that begin with @ are SQL, others are text."""
    return " || ".join(p[1:] if p.startswith("@") else "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for p in parts)


def _table(*rows: list[str], align: str = "") -> str:
    """SQL of a table: every cell is SQL; columns are as wide as their widest cell, 3 to 30 bytes.  align: l, r or another sign a column."""
    wide = [f"least(30, greatest(3, {', '.join(f'strlen({r[j]})' for r in rows)}))" for j in range(len(rows[0]))]

    def line(cells: list[str]) -> str:
        return "'|' || " + " || ".join(f"' ' || {c} || repeat(' ', greatest(0, {w} - strlen({c}))) || ' |'" for c, w in zip(cells, wide, strict=True)) + " || chr(10)"

    ends = [(":" if a == "l" else "-", ":" if a == "r" else "-") for a in align.ljust(len(wide))]
    rule = "'|' || " + " || ".join(f"' {a}' || repeat('-', {w} - 2) || '{z} |'" for w, (a, z) in zip(wide, ends, strict=True)) + " || chr(10)"
    return " || ".join([line(rows[0]), rule, *map(line, rows[1:])])


_FIRST = ["# ", "@s_name", "\n\nAccount of **", "@s_name", "** is _", f"@{A}", "_, see [site](https://example.org/", f"@{K}", ")"]
_PAIR = "@" + _table(["'Key'", "'Name'"], [K, "s_name"])
_NOTE = ["\n[^1]: Counted for ", f"@{K}", ".\n"]
_CODE = ["## Part\n\n", "```\nkey = ", f"@{K}", "\n```\n\nCounted for ", f"@{K}", ".\n\nEnd of `", f"@{K}", "`.\n"]
_SLIDE = ["## ", "@s_name", "\n\n"]
_LAST = ["\n## Last\n\nEnd of ", f"@{K}", ".\n"]
_SHEET = ["## Accounts ", f"@{K}", "\n\n"]
EXPECTED: dict[str, tuple[list[str], str]] = {
    "docx": ([*_FIRST, "[^1].\n\n1. one ", f"@{K}", "\n   - inner\n2. two\n\n", _PAIR, "\nEnd of ", f"@{K}", ".\n", *_NOTE], "docx.tracked-deletions-dropped:1"),
    "odt": ([*_FIRST, "[^1].\n\n1. one ", f"@{K}", "\n   - inner\n2. two\n\n", _PAIR, "\nEnd of ", f"@{K}", ".\n", *_NOTE], ""),
    "rtf": ([*_FIRST, "[^1].\n\n1. one ", f"@{K}", "\n\n2. two\n\n", _PAIR, "\nEnd of ", f"@{K}", ", café €.\n", *_NOTE], ""),
    "rst": ([*_FIRST, ".\n\n- one ", f"@{K}", "\n- two\n\n## Part\n\nCode follows:\n\n", *_CODE[1:]], "markdown.container-attributes-dropped:1"),
    "asciidoc": ([*_FIRST, ".\n\n- one ", f"@{K}", "\n  - inner\n- two\n\n", *_CODE], "asciidoc.include-refused:1,markdown.container-attributes-dropped:1"),
    "doc": (["@s_name", " holds ", f"@{A}", "\n\nsee [site](https://example.org/", f"@{K}", ") now\n\ncell ", f"@{K}", "\n\nnext\\\nline\n"], "doc.styles-omitted:1,doc.tables-flattened:1"),
    "epub": (["# ", "@s_name", "\n\nAccount is **", f"@{A}", "**.\n\n# Last\n\nEnd of _", f"@{K}", "_.\n"], ""),
    "pdf": (["# ", "@s_name", "\n\nAccount is ", f"@{A}", " now and stays so for ", f"@{K}", ".\n\nEnd of ", f"@{K}", ".\n"], "pdf.layout-projection:1"),
    "xlsx": ([*_SHEET, "@" + _table(["'Name'", "'When'", "''", "'Share'"], ["s_name", _DAY, "''", _SHARE], [_FLAG, _CELL, "''", "'\\#N/A'"])], ""),
    "ods": ([*_SHEET, "@" + _table(["'Name'", "'When'", "'Twice'", "'Twice'"], ["s_name", "'2020-01-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0')", _SHARE, "'01:02:03'"], [_FLAG, _CELL, "'wide'", "''"])], ""),
    "xls": ([*_SHEET, "@" + _table(["'Name'", "'When'", "''"], ["s_name", _DAY, "CASE s_suppkey % 4 WHEN 0 THEN CAST(s_suppkey // 4 AS VARCHAR) ELSE regexp_replace(printf('%.2f', s_suppkey * 0.25::DOUBLE), '0+$', '') END"], [_FLAG, _CELL, "'\\#N/A'"])], ""),
    "xlsb": ([*_SHEET, "@" + _table(["'Name'", "'Amount'"], ["s_name", _CELL], [_FLAG, "'\\#DIV/0!'"])], ""),
    "pptx": ([*_SLIDE, "- holds ", f"@{A}", "\n\nCounted for ", f"@{K}", ".\n", *_LAST], "markdown.container-attributes-dropped:1,pptx.presentation-projection:1"),
    "odp": ([*_SLIDE, "holds ", f"@{A}", "\n", *_LAST], "odp.presentation-projection:1"),
    "ppt": ([*_SLIDE, "holds ", f"@{A}", "\n\nand\\\nmore\n", *_LAST], "ppt.presentation-projection:1"),
}
QUERIES: dict[str, Query] = {f"read_{f}": read(f) for f in BUILDERS}
ORACLES: dict[str, str] = {f"read_{f}": f"SELECT s_suppkey, '{f}' AS format, 'success' AS status, {_text(*parts)} AS markdown, '{codes}' AS codes FROM supplier" for f, (parts, codes) in EXPECTED.items()}
