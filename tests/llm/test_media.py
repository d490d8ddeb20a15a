import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from helpers import DOCS, rows, rows_of, table

from leafmill.llm import jpeg_media as J


def test_round_trip_and_digests(spark):
    data = rows()
    got = J.media_features(J.to_media(table(spark, extra=True)))
    want = []
    for d, t, *_ in data:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert rows_of(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=repr)
    twins = {r["text"]: set() for r in table(spark).where("doc_id in (203, 204)").collect()}
    for r in got.where("doc_id in (203, 204)").collect():
        twins["x"].add((r["media_sha256"], r["feature"]))
    assert len(twins["x"]) == 1
    media = {r["doc_id"]: r["media"] for r in J.to_media(table(spark)).collect()}
    for r in got.collect():
        assert r["media_bytes"] == len(media[r["doc_id"]]) and r["media_sha256"] == hashlib.sha256(media[r["doc_id"]]).hexdigest()
    assert J.media_features(J.to_media(spark.createDataFrame([], DOCS))).count() == 0


def test_every_byte_and_long_payloads():
    payloads = [bytes(range(256)), b"\xff" * 640, os.urandom(70_016), bytes(64), b"ab" * (64 * 8191 + 64)]
    media = J.encode_payloads(payloads, [len(p) for p in payloads])
    for p, got in zip(payloads, J.thumbnails(media), strict=True):
        assert np.concatenate([g for _, g in got]).tobytes() == p
    assert len(J.thumbnails(media)[-1]) == 3


class _Bits:
    def __init__(self):
        self.bits = ""

    def put(self, code, n):
        self.bits += f"{code:0{n}b}" if n else ""

    def bytes(self):
        b = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\x00")


def _jpeg(rng, width, height, factors, interval, with_ac):
    """A baseline image with several components, written symbol by symbol; gives it and the luminance DC terms."""
    ac_symbols = bytes([0x00, 0xF0, 0x01, 0x12, 0x33, 0x51])
    ac_bits = bytes([0, 1, 2, 3] + [0] * 12)
    dc, ac = J.codes_of(J.DC_BITS, J.DC_SYMBOLS), J.codes_of(ac_bits, ac_symbols)
    h, v = max(f[0] for f in factors), max(f[1] for f in factors)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    pred, parts, bits, luma = [0] * len(factors), [], _Bits(), {}
    for m in range(across * down):
        if interval and m and m % interval == 0:
            parts.append(bits.bytes() + bytes([0xFF, 0xD0 + (m // interval - 1) % 8]))
            bits, pred = _Bits(), [0] * len(factors)
        for c, (fh, fv) in enumerate(factors):
            for b in range(fh * fv):
                value = rng.randrange(-100, 100)
                diff = value - pred[c]
                pred[c] = value
                size = abs(diff).bit_length()
                bits.put(*dc[size])
                bits.put(diff if diff >= 0 else diff + (1 << size) - 1, size)
                k = 0
                while with_ac and k < 46 and rng.random() < 0.7:
                    rs = rng.choice(ac_symbols[1:])
                    bits.put(*ac[rs])
                    bits.put(rng.getrandbits(rs & 15) if rs & 15 else 0, rs & 15)
                    k += (rs >> 4) + 1
                bits.put(*ac[0])
                if c == 0:
                    luma[m // across * fv + b // fh, m % across * fh + b % fh] = value
    seg = J._segment
    frame = bytes([len(factors)]) + b"".join(bytes([c + 1, fh << 4 | fv, 0]) for c, (fh, fv) in enumerate(factors))
    head = b"\xff\xd8" + seg(0xDB, bytes([0] + [16] * 64)) + seg(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + frame) + seg(0xC4, b"\x00" + J.DC_BITS + J.DC_SYMBOLS + b"\x10" + ac_bits + ac_symbols)
    scan = bytes([len(factors)]) + b"".join(bytes([c + 1, 0x00]) for c in range(len(factors))) + bytes([0, 63, 0])
    image = head + (seg(0xDD, interval.to_bytes(2, "big")) if interval else b"") + seg(0xDA, scan) + b"".join(parts) + bits.bytes() + b"\xff\xd9"
    return image, np.array([[luma[y, x] for x in range(across * factors[0][0])] for y in range(down * factors[0][1])])


@pytest.mark.parametrize("factors", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("interval", [0, 3])
def test_general_images(factors, interval):
    rng = random.Random(interval + len(factors))
    made = [_jpeg(rng, rng.randrange(9, 90), rng.randrange(9, 90), factors, interval, ac) for ac in (False, True, True)]
    for (_, want), got in zip(made, J.thumbnails([m for m, _ in made]), strict=True):
        assert not isinstance(got, str), got
        assert np.array_equal(got[0][1], np.clip((want * 16 + 4 >> 3) + 128, 0, 255))


def test_refusals(spark):
    good = J.encode_payloads([bytes(range(128))], [128])[0]
    bad = [b"", b"GIF89a", good[:40], good.replace(b"\xff\xc0", b"\xff\xc2", 1)]
    assert all(isinstance(x, str) for x in J.thumbnails(bad))
    assert not isinstance(J.thumbnails([good, *bad])[0], str)
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"junk")), (3, None)], "doc_id int, media binary")
    assert [(r["payload_bytes"], r["error"] is None) for r in J.media_features(df).orderBy("doc_id").collect()] == [(128, True), (None, False), (None, False)]
