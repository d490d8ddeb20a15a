"""The pipeline against its stages done one after the other by plain means."""

import hashlib
import re

import pytest
from helpers import rows, table
from test_line_dedup import brute as brute_lines
from test_simhash import brute_fp, groups

import corpus_pipeline
from leafmill.llm import sentencepiece_scan as S
from leafmill.llm.mixing import mix
from leafmill.llm.quality_gbt import quality_rules
from leafmill.llm.queries import MIX_LEVELS, MIX_WEIGHTS, domain_of


@pytest.fixture
def sf(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], i % 2, 0) for i, r in enumerate(rows()) if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages(spark, sf):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        df = f(spark, docs, sf)
        out = f"{sf}/stage{k}"
        df.write.parquet(out)
        docs = spark.read.parquet(out)
        after = docs.collect()
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append((before, after))
    key = lambda r: (repr(r["doc_id"]), repr(r["text"]))
    kept = quality_rules(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()
    assert sorted(repr(r["doc_id"]) for r in kept) == sorted(repr(r["doc_id"]) for r in seen[0][1])
    want = brute_lines([tuple(r) for r in seen[1][0]], 10)
    assert sorted(((r["doc_id"], r["text"]) for r in seen[1][1]), key=repr) == sorted(((d, t) for d, _, _, t in want), key=repr)
    before, after = seen[2]
    fps = [brute_fp(r["text"]) for r in before]
    of = groups(fps, [r["doc_id"] for r in before])
    assert len(after) == len(set(of)) and {r["doc_id"] for r in after} == {c for c in of}
    before, after = seen[3]
    df = spark.createDataFrame(before).withColumn("domain", domain_of())
    copies = {r["doc_id"]: r["copies"] for r in mix(df, MIX_LEVELS, MIX_WEIGHTS, share=1.0).collect()}
    assert sorted(key(r) for r in after) == sorted(k for r in before for k in [key(r)] * copies.get(r["doc_id"], 0))
    lib = S.pieces(S.MODEL).library
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in seen[4][1]) == sorted((r["doc_id"], tuple(lib.encode(r["text"])), sha(r["text"])) for r in seen[4][0])


def test_run_equals_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and {"doc_id", "n_tokens", "ids", "decoded_sha256"} == set(out[0].asDict())
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_only_the_entry_module_guards_the_import():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for p in [*root.glob("leafmill/**/*.py"), root / "corpus_pipeline.py"]:
        text = p.read_text()
        assert not re.search(r"except\s+(ImportError|ModuleNotFoundError)", text), p
        if "llm" not in p.parts and p.name != "corpus_pipeline.py":
            assert "leafmill.llm" not in text, p
