"""Every report code that the sources name is in the catalogue."""

import pathlib
import re

import leafmill
from leafmill.functions.codes import CODES
from leafmill.functions.markdown_writer import CODES as LOSSES
from leafmill.functions.markdown_writer import RULES

ROOT = pathlib.Path(leafmill.__file__).parent
FORMATS = "core|asciidoc|csv|docx?|epub|html|markdown|od[pst]|pdf|pptx?|rst|rtf|text|xls[bx]?"


def test_catalogue():
    named = {c for p in ROOT.rglob("*.py") if "llm" not in p.parts for c in re.findall(rf'"((?:{FORMATS})\.[a-z][a-z0-9]*(?:-[a-z0-9]+)+)"', p.read_text())}
    assert named <= set(CODES), sorted(named - set(CODES))
    assert set(LOSSES) == set(RULES) and set(LOSSES.values()) <= set(CODES)


def test_dynamic_codes():
    for module, formats in (("archive.py", ["docx", "xlsx", "xlsb", "pptx", "odt", "ods", "odp", "epub"]), ("compound.py", ["doc", "xls", "ppt"]), ("odf.py", ["odt", "ods", "odp"])):
        text = (ROOT / "sources" / module).read_text()
        for c in set(re.findall(r'f"\{(?:self\.)?code\}\.([a-z-]+)"', text)):
            missing = [f for f in formats if f"{f}.{c}" not in CODES]
            assert not missing or c == "bad-archive", (module, c, missing)
