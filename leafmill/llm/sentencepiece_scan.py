"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

Encoding is a best path: an edge from piece u to its follower t has a weight, and the path with the greatest sum wins.

* Unigram models: t weighs its score (a character that no piece covers: the least score less 10).
* BPE models, where the right pieces are those that merging by score gives.  A segmentation is that one exactly if each piece
  merges from its own characters and no pair of neighbours would have merged otherwise: cut out of the text, two
  neighbours must encode to themselves (a merge across a border depends on what stands on both sides of it alone, up to
  the first merge across another border).  So the edge weighs 0 if the pair holds and minus infinity if not.

Texts up to ``giant`` characters are one chunk, for which the library is called: it gives the same ids, and takes about a
hundredth of the time that the scan's own steps take in Python.  A longer text is cut into chunks of ``chunk`` characters
with a margin of the longest piece, dealt out one by one, and

1. each chunk yields its transfer matrix: rows are the states it may be entered in (where the piece that covers or ends at
   its first border ends, and for BPE the piece), columns those it may be left in, entries the best sum between them;
2. the matrices, a few states wide, are multiplied (max-plus) up a tree: ``FAN`` neighbours become one, and so on until a
   document is one matrix; from there the way back down gives each product's two states on the best path to its parts.
   No task ever holds more than ``FAN`` matrices of a document, and the rounds grow with the logarithm of its length;
3. each chunk is backtraced on its own between its two states, and the ids are put together.

Decoding joins pieces and bytes back to text.  Round trip is exact but for U+2581, the model's own sign for a
space, which decodes to a space.  The model is read by the driver and broadcast (its file is some hundred kilobytes).

Nulls and edge cases: a null or empty text has no ids; an empty table gives an empty one; a null doc_id is kept; rows alike in
doc_id and text get equal rows each; unknown characters become byte pieces; of paths with equal sums (unigram: the same
pieces in another order) one is taken, always the same, which need not be the library's; columns besides doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import same_key, stage, text_key, tidy

MODEL = os.environ.get("TOKENIZER_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
GIANT, CHUNK, CHUNKS_A_TASK = 65_536, 8_192, 32
#: Matrices that are multiplied at a time.
FAN = 64
#: Rows that the library gets at a time, and pairs of pieces that a worker remembers.
ROWS, PAIRS = 250, 100_000
NO = -np.inf


class Pieces:
    """A model's pieces; for BPE, the merging of short strings."""

    def __init__(self, raw: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(raw)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.unigram = proto.trainer_spec.model_type == 1
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.longest = max(map(len, self.score))
        self.unknown = min(self.score.values()) - 10
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def merge(self, text: str) -> list[str]:
        """Merge the best neighbours, the leftmost of equals, as long as any make a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def alone(self, piece: str) -> bool:
        """Does the piece merge from its own characters?"""
        got = self.whole.get(piece)
        if got is None:
            got = self.whole[piece] = len(piece) == 1 or (piece in self.score and self.merge(piece) == [piece])
        return got

    def holds(self, u: str, t: str) -> bool:
        got = self.pairs.get((u, t))
        if got is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            got = self.pairs[u, t] = self.merge(u + t) == [u, t]
        return got

    def ids(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        return [i] if i is not None else [self.byte[b] for b in piece.encode()]

    def starting(self, text: str, at: int, stop: int) -> list[str]:
        """Pieces that begin at a place: single characters always."""
        out = [text[at]]
        for n in range(2, min(self.longest, stop - at) + 1):
            p = text[at : at + n]
            if p in self.score and (self.unigram or self.alone(p)):
                out.append(p)
        return out

    def weight(self, piece: str) -> float:
        return self.score.get(piece, self.unknown)


@lru_cache(2)
def pieces(path: str) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read())


_loaded: dict[str, Pieces] = {}


class Shipped:
    """A model on its way to the workers: each builds it once."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.key, self.raw = hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)

    def __call__(self) -> Pieces:
        if self.key not in _loaded:
            _loaded.clear()
            _loaded[self.key] = Pieces(self.raw.value)
        return _loaded[self.key]


def marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


State = tuple[int, str]  # where the piece ends, and the piece (unigram: empty, as followers do not depend on it)


def border_states(p: Pieces, text: str, border: int) -> list[State]:
    """States at a border inside text: pieces that begin before it and end at or behind it."""
    out = []
    for start in range(max(0, border - p.longest), border):
        for piece in p.starting(text, start, len(text)):
            if start + len(piece) >= border:
                out.append((start + len(piece), "" if p.unigram else piece))
    return sorted(set(out))


def _walk(p: Pieces, text: str, entries: list[State], begin: int, border: int) -> tuple[dict[int, dict[str, int]], dict[State, int]]:
    """Which entry states (bits) reach each piece: alive[end][piece], up to the first end at or behind border."""
    alive: dict[int, dict[str, int]] = {}
    for k, (end, piece) in enumerate(entries):
        alive.setdefault(end, {})[piece] = 1 << k
    leave: dict[State, int] = {}
    for at in range(begin, len(text) + 1):
        here = alive.get(at)
        if not here:
            continue
        if at >= border:
            for piece, bits in here.items():
                leave[at, piece] = leave.get((at, piece), 0) | bits
            continue
        for t in p.starting(text, at, len(text)):
            bits = 0
            for u, b in here.items():
                if b & ~bits and (not u or p.holds(u, t)):
                    bits |= b
            if bits:
                to = alive.setdefault(at + len(t), {})
                to[t] = to.get(t, 0) | bits
    return alive, leave


def _best(p: Pieces, text: str, entries: list[State], begin: int, border: int) -> tuple[dict[int, np.ndarray], dict[int, tuple[int, str]]]:
    """Unigram: the best sum from each entry state to each place up to the first ones at or behind border, and, of the first entry,
    the piece that the best path to a place ends with and where it begins."""
    sums: dict[int, np.ndarray] = {}
    for k, (end, _) in enumerate(entries):
        sums.setdefault(end, np.full(len(entries), NO))[k] = 0.0
    last: dict[int, tuple[int, str]] = {}
    for at in range(begin, border):
        here = sums.get(at)
        if here is None:
            continue
        for t in p.starting(text, at, len(text)):
            to, there = here + p.weight(t), sums.get(at + len(t))
            if there is None:
                sums[at + len(t)], last[at + len(t)] = to, (at, t)
            else:
                if to[0] > there[0]:
                    last[at + len(t)] = (at, t)
                np.maximum(there, to, out=there)
    return sums, last


def transfer(p: Pieces, text: str, begin: int, border: int, first: bool) -> tuple[list[State], list[State], np.ndarray]:
    """The max-plus matrix of the chunk [begin, border) of text, which has a margin on both sides."""
    entries = [(begin, "")] if first else border_states(p, text, begin)
    if p.unigram:
        sums, _ = _best(p, text, entries, begin, border)
        ends = sorted(x for x in sums if x >= border)
        return entries, [(x, "") for x in ends], np.stack([sums[x] for x in ends], 1)
    _, leave = _walk(p, text, entries, begin, border)
    leaves = sorted(leave)
    m = np.full((len(entries), len(leaves)), NO)
    for j, s in enumerate(leaves):
        for k in range(len(entries)):
            if leave[s] >> k & 1:
                m[k, j] = 0.0
    return entries, leaves, m


def backtrace(p: Pieces, text: str, begin: int, entry: State, leave: State) -> list[str]:
    """The pieces behind entry up to and with leave: the path is unique, so each is found from its end."""
    out, (at, piece) = [], leave
    if p.unigram:
        last = _best(p, text, [entry], begin, leave[0])[1]
        while at != entry[0]:
            at, piece = last[at]
            out.append(piece)
        return out[::-1]
    alive, _ = _walk(p, text, [entry], begin, leave[0])
    while (at, piece) != entry:
        out.append(piece)
        at -= len(piece)
        piece = next(u for u in alive[at] if (at, u) == entry or u in alive[at] and (not u or p.holds(u, piece))) if alive.get(at) else ""
    return out[::-1]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None]).max(1) if a.size and b.size else np.full((a.shape[0], b.shape[1]), NO)


Part = tuple[list[State], list[State], np.ndarray]  # entry states, leave states, matrix; states carry places in the document


def aligned(m: np.ndarray, leaves: list[State], entries: list[State]) -> np.ndarray:
    """Columns by the entry states of what follows, which name the same border."""
    out, at = np.full((m.shape[0], len(entries)), NO), {s: j for j, s in enumerate(entries)}
    for j, s in enumerate(leaves):
        if s in at:
            out[:, at[s]] = m[:, j]
    return out


def product(parts: list[Part]) -> Part:
    entries, leaves, m = parts[0]
    for e, v, x in parts[1:]:
        m, leaves = times(aligned(m, leaves, e), x), v
    return entries, leaves, m


def on_the_path(parts: list[Part], entry: State, leave: State) -> list[tuple[State, State]]:
    """The states between which the best path from entry to leave runs through each of the neighbours."""
    front = [np.where([s == entry for s in parts[0][0]], 0.0, NO)]
    for (_, leaves, m), (e, _, _) in zip(parts, parts[1:], strict=False):
        front.append(aligned(times(front[-1][None, :], m), leaves, e)[0])
    out, last = [], leave
    for (entries, leaves, m), f in zip(parts[::-1], front[::-1], strict=True):
        first = entries[int(np.argmax(f + m[:, leaves.index(last)]))]
        out.append((first, last))
        last = first
    return out[::-1]


def ends_of(part: Part, total: int) -> tuple[State, State]:
    """A whole document's two states."""
    entries, leaves, m = part
    ends = [j for j, s in enumerate(leaves) if s[0] == total]
    return entries[0], leaves[ends[int(np.argmax(m[0, ends]))]]


def _moved(states: list[State], by: int) -> list[State]:
    return [(end + by, piece) for end, piece in states]


def encode_giant(p: Pieces, text: str, chunk: int = 8_192) -> list[str]:
    """The same on one machine; the DataFrame form below deals the chunks out."""
    t = marked(text)
    cuts = [_cut(t, k, chunk, p.longest) for k in range(_chunks(len(t), chunk))]
    parts = []
    for c in cuts:
        a, b, m = transfer(p, c["piece"], c["begin"], c["border"], c["k"] == 0)
        parts.append((_moved(a, c["base"]), _moved(b, c["base"]), m))
    out = []
    for c, (a, b) in zip(cuts, on_the_path(parts, *ends_of(product(parts), len(t))), strict=True):
        out += backtrace(p, c["piece"], c["begin"], (a[0] - c["base"], a[1]), (b[0] - c["base"], b[1]))
    return out


def _chunks(n: int, chunk: int) -> int:
    return max(1, -(-n // chunk))


def _cut(t: str, k: int, chunk: int, margin: int) -> dict:
    base, end = max(0, k * chunk - margin), min(len(t), (k + 1) * chunk)
    return {"k": k, "base": base, "piece": t[base : min(len(t), end + margin)], "begin": k * chunk - base, "border": end - base}


def _by_schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tk long"


def _encode_plain(model: Shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = model().library
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                ids = sp.encode(part.column("text").to_pylist(), num_threads=1)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return run


def _deal_out(model: Shipped, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = model().longest
        for batch in batches:
            for i in range(batch.num_rows):
                t = marked(batch.column("text")[i].as_py())
                n = _chunks(len(t), chunk)
                for a in range(0, n, 64):
                    cuts = [_cut(t, k, chunk, margin) for k in range(a, min(n, a + 64))]
                    at = pa.array([i] * len(cuts))
                    keys = {c: batch.column(c).take(at) for c in ("doc_id", "tk")}
                    cols = {c: pa.array([x[c] for x in cuts], kind) for c, kind in (("k", pa.int32()), ("base", pa.int64()), ("piece", pa.string()), ("begin", pa.int32()), ("border", pa.int32()))}
                    yield pa.record_batch(keys | cols | {"total": pa.array([len(t)] * len(cuts), pa.int64())})

    return run


_STATE = pa.list_(pa.struct([("end", pa.int64()), ("piece", pa.string())]))


def _states(s: list[State]) -> list[dict]:
    return [{"end": e, "piece": p} for e, p in s]


def _matrices(model: Shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model()
        for batch in batches:
            rows = []
            for r in batch.select(["k", "base", "piece", "begin", "border"]).to_pylist():
                a, b, m = transfer(p, r["piece"], r["begin"], r["border"], r["k"] == 0)
                rows.append((_moved(a, r["base"]), _moved(b, r["base"]), m))
            yield _part_rows({c: batch.column(c) for c in ("doc_id", "tk", "total", "k")}, rows)

    return run


def _part_rows(keys: dict[str, pa.Array], parts: list[Part]) -> pa.RecordBatch:
    a, b, m = ([_states(a) for a, _, _ in parts], [_states(b) for _, b, _ in parts], [np.ascontiguousarray(m, np.float64).tobytes() for _, _, m in parts])
    return pa.record_batch(keys | {"entries": pa.array(a, _STATE), "leaves": pa.array(b, _STATE), "m": pa.array(m, pa.binary())})


def _part(x: dict) -> Part:
    e, v = ([(s["end"], s["piece"]) for s in x[c]] for c in ("entries", "leaves"))
    return e, v, np.frombuffer(x["m"], np.float64).reshape(len(e), len(v))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours in order -> their product."""
    for batch in batches:
        yield _part_rows({c: batch.column(c) for c in ("doc_id", "tk", "total", "k")}, [product([_part(x) for x in parts]) for parts in batch.column("parts").to_pylist()])


def _state_rows(keys: dict[str, pa.Array], states: list[tuple[State, State]]) -> pa.RecordBatch:
    cols = {"e_end": [a[0] for a, _ in states], "e_piece": [a[1] for a, _ in states], "l_end": [b[0] for _, b in states], "l_piece": [b[1] for _, b in states]}
    return pa.record_batch(keys | {c: pa.array(x, pa.int64() if c.endswith("end") else pa.string()) for c, x in cols.items()})


def _top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One matrix a document -> its two states."""
    for batch in batches:
        rows = batch.to_pylist()
        yield _state_rows({c: batch.column(c) for c in ("doc_id", "tk", "k")}, [ends_of(_part(r), r["total"]) for r in rows])


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours with the two states of their product -> the two states of each."""
    for batch in batches:
        rows = batch.select(["parts", "e_end", "e_piece", "l_end", "l_piece"]).to_pylist()
        states, at, ks = [], [], []
        for i, r in enumerate(rows):
            states += on_the_path([_part(x) for x in r["parts"]], (r["e_end"], r["e_piece"]), (r["l_end"], r["l_piece"]))
            at += [i] * len(r["parts"])
            ks += [x["k"] for x in r["parts"]]
        keys = {c: batch.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "tk")}
        yield _state_rows(keys | {"k": pa.array(ks, pa.int32())}, states)


def neighbours(level: DataFrame, fan: int) -> DataFrame:
    """Parts of documents, ``fan`` of them to a row, in order."""
    up = F.floor(F.col("k") / fan).cast("int").alias("k")
    return level.groupBy("doc_id", "tk", "total", up).agg(F.array_sort(F.collect_list(F.struct("k", "entries", "leaves", "m"))).alias("parts"))


def scanned(matrices: DataFrame, most: int, by: str, fan: int) -> DataFrame:
    """Matrices of chunks (at most ``most`` to a document) -> the two states of each chunk, up the tree of products and down again."""
    state = "array<struct<end:long,piece:string>>"
    levels = [matrices]
    while most > 1:
        levels.append(stage(neighbours(levels[-1], fan).mapInArrow(tidy(_products), f"{by}, total long, k int, entries {state}, leaves {state}, m binary")))
        most = -(-most // fan)
    rows = f"{by}, k int, e_end long, e_piece string, l_end long, l_piece string"
    states = stage(levels[-1].mapInArrow(tidy(_top), rows))
    for level in levels[-2::-1]:
        parts = neighbours(level, fan)
        both = parts.join(states, same_key(parts, states, ["doc_id", "tk", "k"])).select(parts["doc_id"], parts["tk"], "parts", "e_end", "e_piece", "l_end", "l_piece")
        states = stage(both.mapInArrow(tidy(_down), rows))
    return states


def _backtraces(model: Shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model()
        for batch in batches:
            ids = []
            for r in batch.select(["base", "piece", "begin", "e_end", "e_piece", "l_end", "l_piece"]).to_pylist():
                found = backtrace(p, r["piece"], r["begin"], (r["e_end"] - r["base"], r["e_piece"]), (r["l_end"] - r["base"], r["l_piece"]))
                ids.append([i for x in found for i in p.ids(x)])
            yield pa.record_batch({c: batch.column(c) for c in ("doc_id", "tk", "k")} | {"ids": pa.array(ids, pa.list_(pa.int32()))})

    return run


def encode_ids(docs: DataFrame, model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids, a row for a row."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    by, shipped = _by_schema(docs), Shipped(docs.sparkSession, model)
    small = base.where(F.char_length("text") <= giant).mapInArrow(tidy(_encode_plain(shipped)), by.replace("tk long", "ids array<int>"))
    large = base.where(F.char_length("text") > giant).withColumn("tk", text_key())
    counts = stage(large.groupBy("doc_id", "tk").agg(F.count("*").alias("times"), F.min("text").alias("text")))
    # A chunk costs far more than its bytes say, so tasks are made by their number.
    chars, most = counts.agg(F.sum(F.char_length("text")), F.max(F.char_length("text"))).first()
    tasks = max(counts.sparkSession.sparkContext.defaultParallelism, -(-(chars or 0) // (chunk * CHUNKS_A_TASK)))
    by_chunk = ["doc_id", "tk", "k"]
    dealt = counts.select("doc_id", "tk", "text").mapInArrow(tidy(_deal_out(shipped, chunk)), f"{by}, k int, base long, piece string, begin int, border int, total long").repartition(tasks, *by_chunk)
    state = "array<struct<end:long,piece:string>>"
    matrices = stage(dealt.mapInArrow(tidy(_matrices(shipped)), f"{by}, total long, k int, entries {state}, leaves {state}, m binary"))
    states = scanned(matrices, _chunks((most or 0) + 1, chunk), by, fan)
    both = dealt.join(states, same_key(dealt, states, by_chunk)).select(*[dealt[c] for c in dealt.columns], "e_end", "e_piece", "l_end", "l_piece")
    parts = both.repartition(tasks, *by_chunk).mapInArrow(tidy(_backtraces(shipped)), f"{by}, k int, ids array<int>")
    joined = parts.groupBy("doc_id", "tk").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    times_of = counts.select("doc_id", "tk", "times")
    giants = joined.join(times_of, same_key(joined, times_of, ["doc_id", "tk"])).select(joined["doc_id"], joined["ids"], F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("doc_id", "ids")
    return small.unionByName(giants)


def _lists(column: pa.Array) -> list[list[int]]:
    """to_pylist() of a list column, by way of one flat list.  Null: no ids."""
    flat = column.flatten().to_numpy(zero_copy_only=False).tolist()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids) -> doc_id, n_tokens, ids, text."""
    shipped = Shipped(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = shipped().library
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                ids = _lists(part.column("ids"))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids": part.column("ids"), "text": pa.array(sp.decode(ids) if ids else [], pa.string())})

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids array<int>, text string")


def encode(docs: DataFrame, model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Per row: doc_id, n_tokens, ids, decoded_sha256 (of the ids decoded again)."""
    back = decode(encode_ids(docs, model, giant, chunk, fan), model)
    return back.select("doc_id", "n_tokens", "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
