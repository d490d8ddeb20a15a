"""Command line: python -m leafmill [options] INPUT.  Exit codes: 0 done, 1 conversion, 2 usage, 3 limit."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict, fields
from pathlib import Path

from leafmill import api
from leafmill.functions.limits import Limits

FILTERS: dict[str, object] = {}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafmill", description="Convert a document to Markdown.")
    p.add_argument("input", nargs="?", help="a path, or - for standard input (needs --from and --output or --stdout)")
    p.add_argument("-f", "--from", dest="from_format", metavar="FORMAT")
    p.add_argument("-t", "--to", default="markdown", metavar="FORMAT")
    p.add_argument("-o", "--output", metavar="PATH")
    p.add_argument("--stdout", action="store_true", help="write the document to standard output")
    p.add_argument("--metadata-out", metavar="PATH", help="keep the manifest of a document written to standard output")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--preserve-facets", action="store_true")
    p.add_argument("--filters", action="store_true", help="run the filters registered in FILTERS")
    p.add_argument("--list-formats", action="store_true")
    p.add_argument("--list-filters", action="store_true")
    p.add_argument("--strict", nargs="?", const="content", default="off", choices=[s.value for s in api.Strictness])
    p.add_argument("--quiet", action="store_true", help="leave out notes")
    p.add_argument("--reports", choices=["text", "json"], default="text")
    p.add_argument("--limit", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("-V", "--version", action="version", version="0.1")
    return p


def show(reports: list[api.Report], form: str, quiet: bool) -> None:
    shown = [r for r in reports if not (quiet and r.severity == "note")]
    if form == "json":
        print(json.dumps([asdict(r) for r in shown], sort_keys=True), file=sys.stderr)
        return
    for r in shown:
        print(f"{r.severity}[{r.code}]{': ' + r.consequence if r.consequence else ''}{f' (x{r.count})' if r.count > 1 else ''}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    p = parser()
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 0 if e.code in (0, None) else 2
    if a.list_formats:
        for f in api.formats():
            print(f"{f.name}\t{','.join(f.extensions)}\t{'read,write' if f.can_write else 'read'}")
        return 0
    if a.list_filters:
        print("\n".join(sorted(FILTERS)))
        return 0
    known = {f.name for f in fields(Limits)}
    try:
        pairs = [x.split("=", 1) for x in a.limit]
        if not a.input or a.to != "markdown" or any(len(x) != 2 or x[0] not in known for x in pairs) or (a.input == "-" and not (a.from_format and (a.output or a.stdout))) or (a.metadata_out and not a.stdout):
            p.print_usage(sys.stderr)
            return 2
        limits = Limits(**{k: int(v) for k, v in pairs})
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    c = api.Converter(a.strict, limits, a.preserve_facets, tuple(FILTERS.values()) if a.filters else ())
    try:
        out = c.convert(sys.stdin.buffer.read() if a.input == "-" else a.input, from_format=a.from_format)
        if a.stdout:
            sys.stdout.write(out.artifact)
            if a.metadata_out:
                Path(a.metadata_out).write_text(out.manifest)
        else:
            out.save(a.output or Path(a.input).with_suffix(".md"), a.overwrite)
    except api.InputReadError as e:
        print(e, file=sys.stderr)
        return 1
    except api.ConversionError as e:
        show(e.reports, a.reports, False)
        return 3 if e.exit_class == "limit" else 2 if e.exit_class == "usage" else 1
    show(out.reports, a.reports, a.quiet)
    return 0


if __name__ == "__main__":
    sys.exit(main())
