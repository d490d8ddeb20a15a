"""The single-document API, the command line and the streaming source."""

import json

import packages as P
import pytest

from leafmill import api
from leafmill.__main__ import main
from leafmill.functions.tree import Document
from leafmill.streaming.files import convert_files


def test_convert_bytes_and_errors():
    out = api.convert(P.REPORT, name="r.docx")
    assert out.name == "r.md" and out.source_format == "docx" and out.artifact.startswith("# Harvest")
    assert json.loads(out.manifest)["source"]["format"] == "docx"
    with pytest.raises(api.ConversionError, match="core.strict-refused"):
        api.convert(P.REPORT, strict="exact")
    with pytest.raises(api.LimitExceededError):
        api.convert(b"abcd", from_format="text", limits=api.Limits(max_input_bytes=3))
    with pytest.raises(api.UnknownFormatError):
        api.convert(b"abc")
    with pytest.raises(api.UnknownFormatError):
        api.convert(b"abc", from_format="wat")
    with pytest.raises(api.InputReadError):
        api.convert("/no/such/file.md")
    assert len(api.formats()) == 19 and [f.name for f in api.formats() if f.can_write] == ["markdown"]


def test_save_is_whole_and_does_not_replace(tmp_path):
    body = P.para('<w:r><w:drawing><wp descr="alt"/><a:blip r:embed="i1"/></w:drawing></w:r>')
    (tmp_path / "d.docx").write_bytes(P.docx(body))
    out = api.convert(tmp_path / "d.docx", output=tmp_path / "d.md")
    assert (tmp_path / "d.md").read_text() == "![alt](d_media/image-1.png)\n" and (tmp_path / "d_media/image-1.png").read_bytes() == P.PNG
    assert json.loads((tmp_path / "d.md.leafmill.json").read_text())["media"][0]["pixel_width"] == 3
    with pytest.raises(api.DestinationExistsError):
        out.save(tmp_path / "d.md")
    out.save(tmp_path / "d.md", overwrite=True)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["d.docx", "d.md", "d.md.leafmill.json", "d_media"]


def test_resolution_and_filters():
    assert api.resolve("a.txt", P.pdf(b""), None, True) == ("text", None)
    assert api.resolve("a.txt", P.pdf(b""), None, False) == ("pdf", "core.extension-mismatch")
    assert api.resolve("a", P.xls(), None, False) == ("xls", None) and api.resolve("a", P.pack({"x": "y"}), None, False) == ("docx", None)

    def shout(doc: Document) -> Document:
        doc.body = doc.body[:1]
        return doc

    assert api.convert(b"# a\n\nb", from_format="markdown", filters=(shout,)).artifact == "# a\n"


def test_command_line(tmp_path, capsys):
    f = tmp_path / "a.md"
    f.write_text("# x\n")
    assert main([str(f), "--stdout"]) == 0 and capsys.readouterr().out == "# x\n"
    g = tmp_path / "b.csv"
    g.write_text("a,b\n1\n")
    assert main([str(g)]) == 0 and (tmp_path / "b.md").exists() and "csv.ragged-row" in capsys.readouterr().err
    assert main([str(g)]) == 1 and main([str(g), "--overwrite", "--quiet"]) == 0
    assert main([str(g), "--stdout", "--strict=structure"]) == 1 and main([str(g), "--stdout", "--limit", "max_nodes=2"]) == 3
    assert main([]) == 2 and main(["--nope"]) == 2 and main([str(g), "--limit", "max_nodes"]) == 2 and main(["-", "--stdout"]) == 2
    capsys.readouterr()
    assert main(["--list-formats"]) == 0 and len(capsys.readouterr().out.splitlines()) == 19
    assert main([str(g), "--stdout", "--reports", "json"]) == 0 and json.loads(capsys.readouterr().err)[0]["code"] == "csv.ragged-row"


def test_streaming_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("# a")
    for more in ("b.md", "c.md"):
        convert_files(spark, str(src), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        (src / more).write_text("# " + more)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["markdown"] for r in got.collect()) == ["# a\n", "# b.md\n"]
