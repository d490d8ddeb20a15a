import hashlib
import os
import random

import numpy as np
import pytest
from helpers import DOCS, rows, rows_of, table

from leafmill.llm import sentencepiece_scan as S

pytestmark = pytest.mark.skipif(not os.path.exists(S.MODEL), reason="no vocabulary file")
ODD = ["", " ", "    ", "a  b   c        d" * 9, "日本語 テキスト\n\n\t  \U0001f600 x", "a" * 57, "x\x00y\u00a0z", "ﬁne Ünïcödé", "</s><unk><0x0A>", "hello world"]


def test_ids_are_the_library_s_and_decode_back(spark):
    data = [*rows(), *[(500 + i, t, "", "", 1) for i, t in enumerate(ODD)]]
    lib = S.pieces(S.MODEL).library
    want = sorted(((d, len(lib.encode(t or "")), lib.encode(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in data), key=repr)
    for giant in (S.GIANT, 40):  # nearly all as one chunk; nearly all dealt out in chunks
        got = S.encode(table(spark, data, extra=True), giant=giant, chunk=64)
        assert rows_of(got, "doc_id", "n_tokens", "ids", "decoded_sha256") == want
    assert S.encode(spark.createDataFrame([], DOCS)).count() == 0


def test_scan_equals_the_library_for_any_chunk():
    p, rng = S.pieces(S.MODEL), random.Random(4)
    texts = [*ODD[1:], *["".join(rng.choice(["th", "e", " ", "in", "ation", "  ", "é", "日", "\n", "1", "'s", "ing "]) for _ in range(200)) for _ in range(25)]]
    for t in texts:
        for chunk in (17, 50, 1000):
            assert [i for x in S.encode_giant(p, t, chunk) for i in p.ids(x)] == p.library.encode(t)


def test_matrices_combine_associatively():
    p = S.pieces(S.MODEL)
    t = S.marked("the transfer matrices of neighbouring chunks combine in any order " * 4)
    cuts = [S._cut(t, k, 40, p.longest) for k in range(S._chunks(len(t), 40))]
    parts = []
    for c in cuts:
        a, b, m = S.transfer(p, c["piece"], c["begin"], c["border"], c["k"] == 0)
        parts.append((S._moved(a, c["base"]), S._moved(b, c["base"]), m))
    whole = S.product(parts)
    for cut in range(1, len(parts)):
        two = S.product([S.product(parts[:cut]), S.product(parts[cut:])])
        assert two[:2] == whole[:2] and np.array_equal(two[2], whole[2]) and (whole[2] == 0).any()


def unigram_model(path):
    """A unigram model put together by hand: pieces with scores that no two sums share, and byte pieces."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    rng, m = random.Random(8), pb.ModelProto()
    for name, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=name, score=0.0, type=kind)
    for b in range(256):
        m.pieces.add(piece=f"<0x{b:02X}>", score=0.0, type=6)
    letters = "abcdé ".replace(" ", S.SPACE)
    seen = set(letters) - {"d"}  # d is in pieces, but no piece of its own
    while len(seen) < 90:
        seen.add("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))))
    for x in sorted(seen):
        m.pieces.add(piece=x, score=-rng.uniform(2, 4) - 1.5 * len(x), type=1)
    m.trainer_spec.model_type, m.trainer_spec.vocab_size, m.trainer_spec.byte_fallback = 1, len(m.pieces), True
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = "identity", True, False, True
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_unigram_scores_as_weights(spark, tmp_path):
    """Real sums instead of 0 and minus infinity: every document through chunks, and a tree of products several levels high."""
    path = unigram_model(tmp_path / "unigram.model")
    p, rng = S.pieces(path), random.Random(9)
    assert p.unigram
    texts = ["".join(rng.choice("aabbcdé  z") for _ in range(rng.randrange(1, 700))) for _ in range(40)] + ["", None, "zzz", "d", " "]

    def worth(ids):
        """The sum of a segmentation; runs of byte pieces are characters that no piece covers."""
        bytes_of = {i: b for b, i in p.byte.items()}
        unknown = bytes(bytes_of[i] for i in ids if i in bytes_of).decode()
        return sum(p.score[piece_of[i]] for i in ids if i in piece_of) + p.unknown * len(unknown)

    piece_of = {i: x for x, i in p.id.items()}
    same = 0
    for t in texts:
        want = p.library.encode(t or " ")
        for chunk in (7, 30, 1000):
            got = [i for x in S.encode_giant(p, t or " ", chunk) for i in p.ids(x)]
            assert abs(worth(got) - worth(want)) < 1e-4 and p.library.decode(got) == (t or " ")
            same += got == want  # the same pieces in another order have equal sums, among which the library's rounding decides
    assert same > len(texts)
    data = [(i, t, "", "", 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["ids"] for r in S.encode_ids(table(spark, data), path, giant=0, chunk=16, fan=3).collect()}
    for i, t in enumerate(texts):
        assert abs(worth(got[i]) - worth(p.library.encode(t or ""))) < 1e-4 and p.library.decode(got[i]) == (t or "")


def test_every_document_through_the_scan(spark):
    """The query's table with giant = 0: chunks of small size, products of two, a document of thousands of chunks."""
    data = [*rows(n=12), (900, "many words of one long document " * 1500, "", "", 1)]
    lib = S.pieces(S.MODEL).library
    got = S.encode(table(spark, data), giant=0, chunk=32, fan=2)
    assert rows_of(got, "doc_id", "ids") == sorted(((d, lib.encode(t or "")) for d, t, *_ in data), key=repr)


def test_pieces_merge_as_the_library_does():
    p = S.pieces(S.MODEL)
    for w in ["▁hello", "▁the", "▁transformation", "zzzz", "▁▁▁▁▁"]:
        assert [i for x in p.merge(w) for i in p.ids(x)] == p.library.encode(w.replace("▁", " ")[1:]) or not w.startswith("▁")
