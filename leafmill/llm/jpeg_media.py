"""Media columns: baseline JPEG read in numpy down to luminance thumbnails of DC terms, and a lossless carrier.

Reading: the markers are parsed, stuffing taken out, and the scan cut at its restart markers.  All restart
intervals of all images of a batch that share tables are decoded in lockstep, one lane each: a step reads one
code of every lane by a 16-bit lookup.  AC terms are decoded to be skipped; the DC terms of the first component
are summed up, dequantised and give one sample per 8x8 block, the thumbnail.  An image without restart markers is
one lane.  Grey and colour, sampling factors and separate scans are handled; progressive, arithmetic and
12-bit images are refused.

Carrier: payload byte b becomes one 8x8 block whose quantised DC term is b - 128 under a DC quantiser of 8, so the
thumbnail of the image *is* the payload.  64 blocks a row, a restart interval a row, up to 8191 rows an image;
longer payloads take several images, one after the other.  A comment segment holds the unpadded length.

Edge cases: a null or empty text is 64 zero bytes; equal texts give equal media; the thumbnail hash covers
all samples.  ``media_features`` gives nulls and the reason in ``error`` for bytes that are no such image.  A null doc_id is
kept; rows alike are rows of their own; an empty table gives an empty one; a very long text is several images in one value;
columns besides ``doc_id`` and ``text`` are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import raw_text, tidy

ROW, MAX_ROWS, QUANT = 64, 8191, 8
# The usual code lengths and symbols of luminance DC terms (ITU-T T.81, table K.3).
DC_BITS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
#: The carrier's AC table has one symbol, end of block, of one bit.
AC_BITS, AC_SYMBOLS = bytes([1] + [0] * 15), bytes([0])


class NotBaseline(ValueError):
    pass


def codes_of(bits: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length)."""
    out, code, k = {}, 0, 0
    for length, count in enumerate(bits, 1):
        for _ in range(count):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup_of(bits: bytes, symbols: bytes) -> np.ndarray:
    """16 bits -> length << 8 | symbol; 0 for no code."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in codes_of(bits, symbols).items():
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table


_DC_CODE = np.zeros(12, np.int64)
_DC_LENGTH = np.zeros(12, np.int64)
for _s, (_c, _n) in codes_of(DC_BITS, DC_SYMBOLS).items():
    _DC_CODE[_s], _DC_LENGTH[_s] = _c, _n
_CATEGORY = np.array([int(i).bit_length() for i in range(256)], np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int, length: int) -> bytes:
    return (
        b"\xff\xd8" + _segment(0xFE, b"%d" % length) + _segment(0xDB, bytes([0] + [QUANT] * 64)) + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, b"\x00" + DC_BITS + DC_SYMBOLS) + _segment(0xC4, b"\x10" + AC_BITS + AC_SYMBOLS) + _segment(0xDD, struct.pack(">H", ROW)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def _entropy(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """samples (rows, 64) -> all rows' coded bytes with stuffing, and where each row ends."""
    level = samples.astype(np.int64) - 128
    diff = np.diff(level, axis=1, prepend=0)
    size = _CATEGORY[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    value = (((_DC_CODE[size] << size) | extra) << 1)  # the last bit ends the block
    length = _DC_LENGTH[size] + size + 1
    ends = np.cumsum(length, axis=1)
    bits = ends[:, -1]
    pad = -bits % 8
    value = np.concatenate([value, ((1 << pad) - 1)[:, None]], 1)
    length = np.concatenate([length, pad[:, None]], 1)
    at = np.cumsum(length, axis=1) - length
    n_bytes = (bits + 7) // 8
    words = int(n_bytes.max()) // 4 + 2
    base = np.arange(len(samples))[:, None] * words
    word, room = base + (at >> 5), 64 - (at & 31) - length
    wide = value << room  # within the 64 bits of two words
    flat = word.ravel()
    total = np.bincount(flat, (wide >> 32).ravel(), len(samples) * words) + np.bincount(flat + 1, (wide & 0xFFFFFFFF).ravel(), len(samples) * words + 1)[: len(samples) * words]
    coded = total.astype(np.uint32).astype(">u4").view(np.uint8).reshape(len(samples), words * 4)
    kept = coded[np.arange(words * 4) < n_bytes[:, None]]
    step = 1 + (kept == 0xFF)
    place = np.cumsum(step)
    out = np.zeros(int(place[-1]), np.uint8)
    out[place - step] = kept
    return out, place[np.cumsum(n_bytes) - 1]


def encode_payloads(payloads: list[bytes], lengths: list[int]) -> list[bytes]:
    """Payloads of whole rows -> media bytes."""
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    coded, ends = _entropy(data)
    raw, out, row, begin = coded.tobytes(), [], 0, 0
    stops = ends.tolist()
    for payload, length in zip(payloads, lengths, strict=True):
        rows, parts = len(payload) // ROW, []
        for first in range(0, rows, MAX_ROWS):
            n = min(MAX_ROWS, rows - first)
            parts.append(_header(n, length))
            for r in range(n):
                parts.append(raw[begin : stops[row]])
                begin = stops[row]
                row += 1
                if r < n - 1:
                    parts.append(bytes([0xFF, 0xD0 + r % 8]))
            parts.append(b"\xff\xd9")
        out.append(b"".join(parts))
    return out


def payload_of(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % ROW if raw else ROW)


@dataclass
class Image:
    """What the markers say of one image, and the byte range of the scan with its first component."""

    width: int = 0
    height: int = 0
    quant: dict[int, int] = field(default_factory=dict)
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    tables: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    interval: int = 0
    comment: bytes = b""
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC table, AC table
    used: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    begin: int = 0
    end: int = 0
    stop: int = 0


def _scan_end(raw: bytes, i: int) -> int:
    """Where the next marker that is no restart stands."""
    while True:
        i = raw.find(b"\xff", i)
        if i < 0 or i + 1 >= len(raw):
            return len(raw)
        if raw[i + 1] == 0 or 0xD0 <= raw[i + 1] <= 0xD7:
            i += 2
        elif raw[i + 1] == 0xFF:
            i += 1
        else:
            return i


def _carrier_end(raw: bytes, i: int) -> int:
    """The same for long scans: a marker search on an array."""
    a = np.frombuffer(raw, np.uint8, offset=i)
    at = np.flatnonzero(a[:-1] == 0xFF)
    after = a[at + 1]
    found = at[(after != 0) & (after != 0xFF) & ((after & 0xF8) != 0xD0)]
    return i + int(found[0]) if len(found) else len(raw)


def parse(raw: bytes, at: int = 0) -> Image:
    if raw[at : at + 2] != b"\xff\xd8":
        raise NotBaseline("no start of image")
    im, i = Image(), at + 2
    while i + 4 <= len(raw):
        if raw[i] != 0xFF:
            raise NotBaseline(f"no marker at {i}")
        m = raw[i + 1]
        if m == 0xFF:
            i += 1
            continue
        if m == 0xD9:
            break
        n = struct.unpack_from(">H", raw, i + 2)[0]
        body, i = raw[i + 4 : i + 2 + n], i + 2 + n
        if m == 0xDB:
            while body:
                wide = body[0] >> 4
                im.quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif m in (0xC0, 0xC1):
            bits, im.height, im.width, count = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise NotBaseline(f"{bits}-bit samples")
            im.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
        elif 0xC2 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
            raise NotBaseline(f"frame type {m - 0xC0}")
        elif m == 0xC4:
            while body:
                count = sum(body[1:17])
                im.tables[body[0]] = (body[1:17], body[17 : 17 + count])
                body = body[17 + count :]
        elif m == 0xDD:
            im.interval = struct.unpack(">H", body[:2])[0]
        elif m == 0xFE:
            im.comment = body
        elif m == 0xDA:
            end = _scan_end(raw, i) if len(raw) - i < 256 else _carrier_end(raw, i)
            ids = [c[0] for c in im.components]
            scan = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            if any(c == 0 for c, _, _ in scan):
                im.scan, im.begin, im.end = scan, i, end
                im.used = {t: im.tables[t] for _, d, a in scan for t in (d, 16 + a)}
            i = end
            if raw[i : i + 2] == b"\xff\xd9":
                break
    if not im.scan or not im.width or not im.height:
        raise NotBaseline("no scan")
    im.stop = min(len(raw), i + 2)
    return im


def _shape(im: Image) -> tuple[int, int, list[tuple[int, int]]]:
    """MCUs across and down, and (h, v) of each component of the scan."""
    if len(im.scan) == 1:
        c = im.components[im.scan[0][0]]
        h_max, v_max = max(x[1] for x in im.components), max(x[2] for x in im.components)
        w, h = -(-im.width * c[1] // h_max), -(-im.height * c[2] // v_max)
        return -(-w // 8), -(-h // 8), [(1, 1)]
    factors = [(im.components[c][1], im.components[c][2]) for c, _, _ in im.scan]
    h_max, v_max = max(x[1] for x in im.components), max(x[2] for x in im.components)
    return -(-im.width // (8 * h_max)), -(-im.height // (8 * v_max)), factors


def _lanes(raw: np.ndarray, starts: list[int], stops: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scans -> bytes without stuffing or markers (each lane followed by padding), lane starts, and the scan of
    each lane."""
    pieces = [raw[a:b] for a, b in zip(starts, stops, strict=True)]
    a = np.concatenate(pieces)
    scan_at = np.cumsum([0] + [len(p) for p in pieces])[:-1]
    ff = np.flatnonzero(a[:-1] == 0xFF)
    ff = ff[~np.isin(ff + 1, scan_at)] if len(pieces) > 1 else ff
    after = a[ff + 1]
    restart = ff[(after & 0xF8) == 0xD0]
    drop = np.zeros(len(a), bool)
    drop[ff[after == 0] + 1] = True
    drop[restart] = True
    drop[restart + 1] = True
    begins = np.sort(np.concatenate([scan_at, restart + 2]))
    kept_before = np.cumsum(~drop) - ~drop
    lane = np.minimum(begins, len(a) - 1)
    at = np.where(begins < len(a), kept_before[lane], int((~drop).sum()))
    scan = np.searchsorted(scan_at, begins, side="right") - 1
    return np.concatenate([a[~drop], np.full(8, 0xFF, np.uint8)]), at, scan


def _decode_lanes(data: np.ndarray, at: np.ndarray, mcus: np.ndarray, scan: list[tuple[int, int, int]], factors: list[tuple[int, int]], tables: dict[int, tuple[bytes, bytes]]) -> np.ndarray:
    """DC terms of component 0: (lanes, most MCUs, its blocks an MCU)."""
    d = data.astype(np.uint32)
    window = d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]
    top = len(window) - 1
    luts = {t: lookup_of(*b) for t, b in tables.items()}
    order = np.argsort(-mcus, kind="stable")  # lanes that are done leave at the end
    pos, left = at[order] * 8, mcus[order]
    k0 = next(k for k, s in enumerate(scan) if s[0] == 0)
    out = np.zeros((len(at), int(mcus.max()), factors[k0][0] * factors[k0][1]), np.int32)
    pred = np.zeros((len(scan), len(at)), np.int32)

    def peek(p: np.ndarray) -> np.ndarray:
        return window[np.minimum(p >> 3, top)] << (p & 7).astype(np.uint32)

    for m in range(out.shape[1]):
        n = int(np.searchsorted(-left, -m, side="left"))  # lanes with more than m MCUs
        p = pos[:n]
        for k, (component, dc, ac) in enumerate(scan):
            dc_lut, ac_lut = luts[dc], luts[16 + ac]
            for b in range(factors[k][0] * factors[k][1]):
                w = peek(p)
                got = dc_lut[w >> np.uint32(16)]
                size = got & 255
                p = p + (got >> 8)
                w = peek(p)
                bits = (w >> np.uint32(1)).astype(np.int64) >> (31 - size)
                value = np.where(bits >> np.maximum(size - 1, 0) == 0, bits - (1 << size) + 1, bits)
                pred[k, :n] += np.where(size > 0, value, 0).astype(np.int32)
                p = p + size
                if component == 0:
                    out[:n, m, b] = pred[k, :n]
                going, term = np.arange(n), np.zeros(n, np.int32)
                while len(going):
                    got = ac_lut[peek(p[going]) >> np.uint32(16)]
                    rs = got & 255
                    p[going] += (got >> 8) + (rs & 15)
                    term[going] += (rs >> 4) + 1
                    going = going[(rs != 0) & (got != 0) & (term[going] < 63)]
        pos[:n] = p
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back]


def thumbnails(media: list[bytes]) -> list[list[tuple[Image, np.ndarray]] | str]:
    """Of each media value: its images with their thumbnails (uint8, a sample for each luminance block), or why not."""
    found: list[list[tuple[Image, np.ndarray]] | str] = []
    groups: dict[tuple, list[tuple[int, int, Image]]] = defaultdict(list)
    for i, raw in enumerate(media):
        images: list[tuple[Image, np.ndarray]] = []
        try:
            at = 0
            while at < len(raw):
                im = parse(raw, at)
                groups[tuple(im.scan), tuple(sorted(im.used.items())), tuple(_shape(im)[2])].append((i, len(images), im))
                images.append((im, np.zeros((0, 0), np.uint8)))
                at = im.stop
            found.append(images or "no image")
        except (NotBaseline, struct.error, IndexError, KeyError, ValueError) as e:
            found.append(f"{type(e).__name__}: {e}")
    for (scan, tables, factors), members in groups.items():
        members = [m for m in members if not isinstance(found[m[0]], str)]
        if not members:
            continue
        raw = np.frombuffer(b"".join(media[i][im.begin : im.end] for i, _, im in members), np.uint8)
        stops = np.cumsum([im.end - im.begin for _, _, im in members])
        data, at, of = _lanes(raw, [0, *stops[:-1].tolist()], stops.tolist())
        shapes = [_shape(im) for _, _, im in members]
        per = np.array([im.interval or s[0] * s[1] for (_, _, im), s in zip(members, shapes, strict=True)])
        all_mcus = np.array([s[0] * s[1] for s in shapes])
        first = np.searchsorted(of, np.arange(len(members)))
        rank = np.arange(len(of)) - first[of]
        mcus = np.clip(all_mcus[of] - rank * per[of], 0, per[of])
        dc = _decode_lanes(data, at, mcus, list(scan), list(factors), dict(tables))
        k0 = next(k for k, s in enumerate(scan) if s[0] == 0)
        h, v = factors[k0]
        lane_of = np.append(first, len(of))
        for g, (i, j, im) in enumerate(members):
            across, down, _ = shapes[g]
            flat = dc[lane_of[g] : lane_of[g + 1], : per[g]].reshape(-1, h * v)[: across * down]
            if len(flat) < across * down:
                found[i] = "the scan ends early"
                continue
            if isinstance(found[i], str):
                continue
            q = im.quant.get(im.components[0][3], 1)
            blocks = flat.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            grey = np.clip((blocks * q + 4 >> 3) + 128, 0, 255).astype(np.uint8)
            found[i][j] = (im, grey)
    return found


def average_hash(grey: np.ndarray) -> int:
    """64 bits: which of 8 by 8 cells are lighter than their mean.  Small images repeat their samples."""
    rows = np.minimum(np.arange(8) * grey.shape[0] // 8, grey.shape[0] - 1)
    cols = np.minimum(np.arange(8) * grey.shape[1] // 8, grey.shape[1] - 1)
    sums = np.add.reduceat(np.add.reduceat(grey.astype(np.int64), rows, 0), cols, 1)
    ends_r, ends_c = np.append(rows[1:], grey.shape[0]), np.append(cols[1:], grey.shape[1])
    means = sums / (np.maximum(ends_r - rows, 1)[:, None] * np.maximum(ends_c - cols, 1)[None, :])
    return int(np.packbits((means > means.mean()).ravel()).view(">u8")[0])


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, s in enumerate(sizes):
        if held and held + s > most:
            yield begin, i
            begin, held = i, 0
        held += s
    if begin < len(sizes):
        yield begin, len(sizes)


def to_media(docs: DataFrame, most: int = 2_000_000) -> DataFrame:
    """docs (doc_id, text) -> doc_id, media."""
    base = docs.select("doc_id", raw_text().alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("raw")
            sizes = [len(x.as_buffer()) for x in raws]
            for a, b in _slices(sizes, most):
                part = [x.as_py() for x in raws.slice(a, b - a)]
                media = encode_payloads([payload_of(x) for x in part], [len(x) for x in part])
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(a, b - a), "media": pa.array(media, pa.binary())})

    return base.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, n_bytes long, media_bytes long, media_sha256 string, width int, height int, images int, thumb_xxh64 string, average_hash string, feature string, error string"


def media_features(media: DataFrame, id_col: str = "doc_id", most: int = 3_000_000) -> DataFrame:
    """media (id, media) -> id, the thumbnail's samples in digests, dimensions, thumbnail hashes, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("media")
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in values]
            for a, b in _slices(sizes, most):
                part = [x.as_py() or b"" for x in values.slice(a, b - a)]
                rows = []
                for raw, got in zip(part, thumbnails(part), strict=True):
                    stored = [len(raw), hashlib.sha256(raw).hexdigest()]
                    if isinstance(got, str):
                        rows.append([None, None, None, None, *stored, *[None] * 6, got])
                        continue
                    grey = np.concatenate([g for _, g in got]) if len({g.shape[1] for _, g in got}) == 1 else got[0][1]
                    samples = grey.tobytes()
                    im = got[0][0]
                    n = int(im.comment) if im.comment.isdigit() else None
                    height = sum(x.height for x, _ in got)
                    thumb, avg = f"{xxhash.xxh64_intdigest(samples):016x}", f"{average_hash(grey):016x}"
                    rows.append([len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), n, *stored, im.width, height, len(got), thumb, avg, f"{im.width}x{height}:{thumb}:{avg}", None])
                cols = dict(zip([c.split()[0] for c in _FEATURES.split(", ")], [list(c) for c in zip(*rows, strict=True)], strict=True))
                kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
                out = {c.split()[0]: pa.array(cols[c.split()[0]], kinds[c.split()[1]]) for c in _FEATURES.split(", ")}
                yield pa.record_batch({id_col: batch.column(id_col).slice(a, b - a)} | out)

    return media.select(id_col, "media").mapInArrow(tidy(run), f"{id_col} {media.schema[id_col].dataType.simpleString()}, {_FEATURES}")
