"""Columns of text as flat bytes, word hashes over them, and small helpers of the operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that go to Python at once: texts are long, so far below Spark's default.
BATCH_ROWS = 512
#: Bits of a filter of ids: 2 MB, whatever the corpus holds. What wrongly passes costs work only.
FILTER_BITS = 1 << 24
#: Bytes of text that are hashed at once.
WINDOW = 1 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Space and the control characters from tab to carriage return.
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: All ASCII characters but letters and digits.
NOT_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def open_store(path: str):
    """(file system, path in it) of a folder or file that all machines reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path)) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of texts small; a setting of the session that changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidy(run: Callable) -> Callable:
    """run for mapInArrow, giving memory back to the system at the end of the task: Python workers live on."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def filter_place(col: str) -> list[Column]:
    """Columns b and p: the bitmap bucket and position of a hashed id."""
    h = F.pmod(F.xxhash64(F.col(col)), F.lit(FILTER_BITS))
    return [F.call_function("bitmap_bucket_number", h).alias("b"), F.call_function("bitmap_bit_position", h).alias("p")]


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bit for each hashed id of the column id; its size is fixed."""
    rows = ids.select(*filter_place("id")).groupBy("b").agg(F.expr("bitmap_construct_agg(p)").alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8 + 4096, np.uint8)
    for r in rows:
        bits = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["b"] * 4096 : r["b"] * 4096 + len(bits)] |= bits
    return out


def passes(bits: np.ndarray, bucket: pa.Array, position: pa.Array) -> np.ndarray:
    """Which rows of filter_place columns may be among the ids."""
    where, pos = bucket.to_numpy(), position.to_numpy()
    return (bits[where * 4096 + pos // 8] >> (pos % 8).astype(np.uint8)) & 1 > 0


def among(df: DataFrame, bits: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """The rows of df whose id may be among those of the filter, found where they are; a join on the few rows left settles it."""

    def run(batches):
        for b in batches:
            keep = passes(bits, b.column(b.num_columns - 2), b.column(b.num_columns - 1))
            yield b.filter(pa.array(keep)).select(list(range(b.num_columns - 2)))

    arrow_batches(df.sparkSession)
    where, position = filter_place(id_col)
    return df.select("*", where.alias("__bucket"), position.alias("__position")).mapInArrow(tidy(run), df.schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits (splitmix64's finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one text after the other, and the offsets; null: empty."""
    a = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    large = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    _, where, data = a.buffers()
    if len(a) == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    off = np.frombuffer(where, np.int64 if large else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** 0, 1, ... and their inverses modulo 2 ** 64, n of each at least."""
    size = max(WINDOW + 1, 1 << int(n - 1).bit_length()) if n > WINDOW + 1 else WINDOW + 1
    if size not in _powers:
        out = []
        for base in (_BASE, _UNBASE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x))
        if size > WINDOW + 1:
            return out[0], out[1]  # of a single huge word: not kept
        _powers[size] = (out[0], out[1])
    return _powers[size]


def windows(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(from byte, to byte, first text, last text + 1): about WINDOW bytes each, cut between words only."""
    n, at, row = len(data), 0, 0
    rows = len(offsets) - 1
    while at < n:
        end = min(n, at + WINDOW)
        if end < n:
            k = int(np.searchsorted(offsets, end, "right")) - 1
            if offsets[k] > at:
                end = int(offsets[k])
            else:  # one text is longer than the window: cut it at a separator
                while True:
                    gaps = np.flatnonzero(sep[data[at:end]])
                    if len(gaps) and gaps[-1] > 0:
                        end = at + int(gaps[-1])
                        break
                    if end == n or end >= offsets[k + 1]:
                        end = min(n, int(offsets[k + 1]))
                        break
                    end = min(n, int(offsets[k + 1]), end + WINDOW)
        row = int(np.searchsorted(offsets, at, "right")) - 1
        last = int(np.searchsorted(offsets, end, "left"))
        yield at, end, row, min(rows, last)
        at = end


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of bytes outside sep, A-Z lower-cased) and, for each text, where its words begin.

    The hash of a word depends on its bytes alone: a polynomial over random values of bytes, mixed.
    """
    hashes, starts_at = [], []
    for a, b, row, last in windows(data, offsets, sep):
        x = _LOWER[data[a:b]]
        gap = sep[x]
        edge = np.ones(len(x) + 1, bool)
        edge[1:-1] = False
        inner = offsets[row:last] - a
        edge[inner[(inner >= 0) & (inner <= len(x))]] = True
        start = ~gap
        start[1:] &= gap[:-1] | edge[1:-1]
        stop = ~gap
        stop[:-1] &= gap[1:] | edge[1:-1]
        s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
        p, q = powers(len(x) + 1)
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTE[x] * p[: len(x)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * q[s] + _U(1)))
        starts_at.append(s + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_at), offsets, "left")


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of all texts and where each text's begin; a text of fewer words gives one of them all."""
    n = len(h) - k + 1
    counts = np.diff(first)
    if n > 0:
        s = np.zeros(n, np.uint64)
        for i in range(k):
            s = s * _U(_BASE) + h[i : i + n]
        s = mix(s)
    else:
        s = np.zeros(0, np.uint64)
    inside = np.zeros(len(h), bool)
    own = np.maximum(counts - k + 1, 0)
    marks = np.zeros(len(h) + 1, np.int64)
    np.add.at(marks, first[:-1][own > 0], 1)
    np.add.at(marks, (first[:-1] + own)[own > 0], -1)
    inside = np.cumsum(marks[:-1]) > 0
    out = s[inside[: max(n, 0)]] if n > 0 else s
    short = np.flatnonzero((counts > 0) & (counts < k))
    at = np.concatenate([[0], np.cumsum(own)])
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j, r in enumerate(short):
            x = _U(0xA5A5A5A5A5A5A5A5 + int(counts[r]))
            with np.errstate(over="ignore"):
                for w in h[first[r] : first[r + 1]]:
                    x = x * _U(_BASE) + w
            extra[j] = x
        out = np.insert(out, at[short], mix(extra))
        own = own.copy()
        own[short] = 1
        at = np.concatenate([[0], np.cumsum(own)])
    return out, at
