"""Small helpers that the operators share: text bytes, row identity, staged tables."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_U = np.uint64
_own_dirs: dict[str, str] = {}
_staged: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of files.  One with fewer splits than there are cores is dealt out to all of them: the operators spend far
    more time on a row than it takes to move it.  A large table has splits enough and is left as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, on a local master alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="stage-")
    return _own_dirs[app]


def stage(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, so that a lost
    executor costs no recomputation of what came before, and later joins see a plain scan."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def finished(make: Callable[[], DataFrame]) -> DataFrame:
    """stage() of what make gives; the tables that make staged on the way are removed once its result is written."""
    before = len(_staged)
    out = stage(make())
    mine, _staged[before:] = _staged[before:-1], _staged[-1:]
    _remove(mine)
    return out


def _remove(staged: list[tuple[SparkSession, str]]) -> None:
    for spark, path in staged:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_staged() -> None:
    try:
        _remove(_staged)
    except Exception:  # noqa: BLE001 - the session may be gone already
        return


atexit.register(_remove_staged)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """For functions over Arrow batches: when a partition is done, its memory goes back to the system.  Workers serve many
    stages, and what allocators keep of each would add up."""

    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return inner


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns of docs as one struct d, and more columns beside it: no name of docs can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), *[c.alias(n) for n, c in more.items()])


def unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])


def text_key(text: Column | str = "text") -> Column:
    """Tells rows of one doc_id apart; rows equal in both are copies with equal results."""
    return F.xxhash64(text)


def raw_text(text: Column | str = "text") -> Column:
    """The text's UTF-8 bytes; null: none."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def same_key(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    """Null-safe equality on names, usable as an equi-join key."""
    cond = None
    for n in names:
        c = a[n].eqNullSafe(b[n])
        cond = c if cond is None else cond & c
    return cond


def words_of(raw: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ : bytes.split() divides at exactly these six bytes."""
    return raw.split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a polynomial hash depends on every other."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Poly:
    """Polynomial hashes of word ranges modulo 2**64 by prefix sums."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes)
        power, self.inverse = self._powers(base, n + 1)
        self.prefix = np.zeros(n + 1, _U)
        np.cumsum(hashes * power[:n], out=self.prefix[1:])

    @classmethod
    def _powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._tables.get(base)
        if have is None or len(have[0]) < n:
            size = 1 << max(12, int(n).bit_length())

            def run(b: int) -> np.ndarray:
                a = np.full(size, b, _U)
                a[0] = 1
                return np.cumprod(a, dtype=_U)

            have = run(base), run(pow(base, -1, 1 << 64))
            cls._tables[base] = have
        return have

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.prefix[start + length] - self.prefix[start]) * self.inverse[start])

    def grams(self, length: int) -> np.ndarray:
        n = len(self.prefix) - length
        return mix((self.prefix[length:] - self.prefix[:n]) * self.inverse[:n])


BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03

# ---------------------------------------------------------------------- words of many texts at once
#: Bytes of text worked on at a time, and the longest word that is hashed by sums.
PIECE, LONG = 1_000_000, 255
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def runs(to: np.ndarray) -> list[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    ends = np.append(np.flatnonzero(np.diff(to)) + 1, len(to)).tolist() if len(to) else []
    return list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []


def slices(raws: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most so many bytes, or one row."""
    begin = held = 0
    for i in range(len(raws)):
        n = len(raws[i].as_buffer())
        if held and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(raws):
        yield begin, len(raws)


@lru_cache(1)
def _byte_powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte value, and the powers of a base and of its inverse, for sums over PIECE bytes."""
    size = PIECE + LONG + 2
    out = [mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))]
    for b in (BASE_A, pow(BASE_A, -1, 1 << 64)):
        a = np.full(size, b, _U)
        a[0] = 1
        out.append(np.cumprod(a, dtype=_U))
    return tuple(out)


def tokens_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text that ends with a blank -> where its words begin and end, and their hashes."""
    x = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([0], (~_BLANK.take(x)).view(np.int8)))
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    value, power, inverse = _byte_powers()
    out = np.zeros(len(starts), _U)
    length = ends - starts
    for a, b in runs(starts // PIECE):
        lo, hi = int(starts[a]), int(starts[b - 1]) + min(int(length[b - 1]), LONG)
        prefix = np.zeros(hi - lo + 1, _U)
        np.cumsum(value.take(x[lo:hi]) * power[: hi - lo], out=prefix[1:])
        s, e = starts[a:b] - lo, np.minimum(ends[a:b], hi) - lo
        out[a:b] = mix((prefix[e] - prefix[s]) * inverse[s])
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return starts, ends, out
