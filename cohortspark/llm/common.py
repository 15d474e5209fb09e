"""Helpers shared by the text operators: scratch tables, Arrow iteration, byte-level word hashing."""

from __future__ import annotations

import gc
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.session import checkpoint_dir

U = np.uint64
_ODD = 0x9E3779B97F4A7C15 | 1
_INV = pow(_ODD, -1, 1 << 64)
#: Text bytes that one numpy step works on at most, unless a single document is longer.
STEP_BYTES = 2 << 20


# ---------------------------------------------------------------- scratch tables

def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables written by ``materialize`` that no later step reads, and let Spark drop the shuffle files of dead frames."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    jvm.System.gc()


def pack_counts(counts: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(counts).tobytes(), 1)


def unpack_counts(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype=dtype)


def sum_counts(partials: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Add up ``counts`` (packed int64 vectors of ``size`` entries) by ``keys``.

    The vectors are of fixed size, so a task holds one sum and one addend. A first
    round adds within ``salt`` (a hash of the producing task) so that no task reads all partials.
    """
    schema = ", ".join(f"`{k}` {t}" for k, t in partials.dtypes if k in keys)

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for pdf in frames:
            for blob in pdf["counts"]:
                total += unpack_counts(blob, np.int64)
        yield pd.DataFrame([[*key[:len(keys)], pack_counts(total)]], columns=[*keys, "counts"])

    schema = ", ".join([*([schema] if schema else []), "counts binary"])
    one = partials.groupBy(*keys, F.pmod(F.col("salt"), F.lit(32))).applyInPandas(add, schema)
    return one.groupBy(*keys).applyInPandas(add, schema)


#: Large dictionaries that a Python worker keeps from task to task; tasks of other operators give their memory back.
WORKER_CACHES: list[dict] = []


def forget_caches() -> None:
    for cache in WORKER_CACHES:
        cache.clear()


# ---------------------------------------------------------------- Arrow iteration

def text_steps(batches: Iterable[pa.RecordBatch], column: str = "text", step: int = STEP_BYTES, lower: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches into steps of about ``step`` bytes of text.

    Yields (batch, bytes, offsets): the UTF-8 bytes of the step's texts back to back and
    the n + 1 offsets of the documents in them, lower-cased if asked. Null texts are empty. No text is cut.
    """
    forget_caches()
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(column)
        col = batch.column(i)
        col = col.cast(pa.large_string()).fill_null("") if col.type != pa.binary() else col.cast(pa.large_binary()).fill_null(b"")
        if lower:
            col = pa.compute.utf8_lower(col)
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + step, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
            lo = hi


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Whole groups of a partition sorted by ``keys``: tables of one or more complete groups.

    Consecutive groups are handed out together until they hold about ``rows`` rows.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(table.num_rows, bool)
        for k in keys:
            col = table.column(k).combine_chunks()
            last &= np.asarray(pa.compute.equal(col, col[len(col) - 1]).fill_null(False))
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        n = table.num_rows - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


# ---------------------------------------------------------------- hashing

def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser, vectorised."""
    h = h ^ U((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xA0761D6478BD642F)
    return h ^ (h >> U(32))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """odd^i and odd^-i modulo 2^64 for i < n (kept per worker)."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _ODD), ("down", _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of values[i:j] times odd powers of their positions (n + 1 entries)."""
    up, _ = powers(len(values))
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + U(1)) * up, out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the values in [start, end), the same wherever they stand."""
    _, down = powers(len(s))
    return mix((s[end] - s[start]) * down[start], seed)


_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of the words, and the index of each document's first word (n + 1 entries).

    A word is a maximal run of ASCII letters, digits and bytes above 127 inside one document.
    """
    m = _WORD[data]
    if not len(m):
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    s, e = m.copy(), m.copy()
    s[1:] &= ~m[:-1]
    e[:-1] &= ~m[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(m))]
    s[cuts] = m[cuts]
    e[cuts - 1] = m[cuts - 1]
    start = np.flatnonzero(s)
    return start, np.flatnonzero(e) + 1, np.searchsorted(start, offsets)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z folded) and the first-word index of each document."""
    start, end, first = words(data, offsets)
    return span_hash(prefix_hash(_FOLD[data]), start, end), first


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and each document's first shingle (n + 1 entries).

    A document of 1 to k - 1 words has one shingle, of all its words.
    """
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(n)), counts)
    at = np.arange(begin[-1]) - begin[doc] + first[doc]
    out = np.zeros(len(at), np.uint64)
    short = n[doc] < k
    for j in range(k):
        pos = np.minimum(at + j, max(len(h) - 1, 0))
        term = mix(h[pos], j + 1) if len(h) else out
        out += np.where(short & (j >= n[doc]), U(0), term)
    return mix(out, 99), begin


def crc_of(column: str):
    """crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns (extra columns, whatever their names, go no further)."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


#: Keys that hold more than this share of all rows count as hot; there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 4096


def join_unique(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with a table that has each non-null ``key`` once and the ``count`` of its rows.

    Hot keys are joined by broadcast (fewer than 4096 rows whatever the size of the data), all others by shuffle, so that no task takes a hot key's
    rows. Both sides are read twice; hand in written tables.
    """
    table, _ = materialize(table, "keys")
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > total * HOT_SHARE
    often = F.broadcast(table.where(hot))
    rest = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti")
    return rows.join(often, key).unionByName(rest.join(table.where(~hot), key))
