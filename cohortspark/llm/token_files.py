"""Token-ID files: tokenise whole texts, write the ids in ascending document order with the rANS coder, read them back.

``write_tokens`` makes two passes that spread over the cluster: texts to ids (kept in the shared folder) and their counts, whose
sum gives the shared frequency table, and a range partition by document id in which each task encodes its own blocks.
``read_tokens`` decodes the blocks in parallel; a document longer than a block has its checksum combined from parts.

Edge cases: null texts are empty; every document ends with ``end_id``, so an empty one has one id. Repeated ids are all written,
ordered by a hash of their ids; null ids come first. An empty table gives an empty container with a flat table.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import rans
from cohortspark.llm.common import forget_caches, materialize, pack_counts, plain, release, scratch, sum_counts, unpack_counts
from cohortspark.llm.tokens import default_path, encoder

BLOCK_TOKENS = 1 << 20
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial (lowest power in the highest bit)."""
    p = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            p ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return p


def crc_join(first: int, second: int, n_bytes: int) -> int:
    """crc32 of two byte strings put together, from their checksums and the second one's length."""
    shift, power, n = 1 << 31, 1 << 23, n_bytes  # x^0 and x^8
    while n:
        if n & 1:
            shift = _times(shift, power)
        power = _times(power, power)
        n >>= 1
    return _times(first, shift) ^ second


def token_ids(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """(doc_id, ids, salt, counts): the packed ids of each text, ``end_id`` last. Ids take 2 bytes if the vocabulary allows.

    Each task ends with one row that has counts instead: how often it wrote each of the ``size`` ids.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc = encoder(tokenizer, 1_500_000)
        tail = np.asarray([end_id], enc.dtype).tobytes()
        total, schema = np.zeros(size, np.int64), pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("salt", pa.int64()), ("counts", pa.binary())])
        gc.disable()  # nothing here is cyclic, and the collector would walk the lists of words again and again
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    step = batch.slice(lo, 256)
                    blobs = [b + tail for b in enc.encode(step.column(1).to_pylist())]
                    total += np.bincount(np.frombuffer(b"".join(blobs), enc.dtype), minlength=size)
                    none = pa.nulls(len(blobs))
                    yield pa.RecordBatch.from_arrays([step.column(0), pa.array(blobs, pa.binary()), none.cast(pa.int64()), none.cast(pa.binary())], schema=schema)
        finally:
            gc.enable()
        yield pa.RecordBatch.from_pydict({"doc_id": [None], "ids": [None], "salt": [TaskContext.get().partitionId()], "counts": [pack_counts(total)]}, schema=schema)

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(part, "doc_id long, ids binary, salt long, counts binary")


def id_dtype(tokenizer: str) -> np.dtype:
    from tokenizers import Tokenizer
    return np.dtype("<u2") if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else np.dtype("<u4")


def write_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0) -> None:
    """Write the container: ``path``/blocks (one row per block) and ``path``/table (id, frequency)."""
    spark, tokenizer = df.sparkSession, tokenizer or default_path()
    dtype = id_dtype(tokenizer)
    from tokenizers import Tokenizer
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    ids, ids_path = materialize(token_ids(df, id_col, text_col, tokenizer, end_id, size), "ids")
    counts = sum_counts(ids.where("counts is not null").select("salt", "counts"), [], size).collect()
    freq = rans.scale(sum((unpack_counts(r["counts"], np.int64) for r in counts), np.zeros(size, np.int64)))
    ids = ids.where("counts is null").select("doc_id", "ids")
    spark.createDataFrame(pd.DataFrame({"id": np.arange(size), "freq": freq})).coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        forget_caches()  # the words of the pass before are not needed any more
        table, shard = rans.Table(shared.value), TaskContext.get().partitionId()
        number = done = ordinal = 0
        held: list[tuple[int | None, int, int, np.ndarray]] = []  # id, ordinal in the shard, start in the shard, ids
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            payload = rans.encode(np.concatenate([h[3] for h in held]), table)
            row = {"shard": [shard], "block": [number], "n_tokens": [size], "payload": [payload],
                   "doc_ids": pa.array([[h[0] for h in held]], pa.list_(pa.int64())), "ordinals": pa.array([[h[1] for h in held]], pa.list_(pa.int64())),
                   "starts": pa.array([[h[2] for h in held]], pa.list_(pa.int64())), "lengths": pa.array([[len(h[3]) for h in held]], pa.list_(pa.int64()))}
            held.clear()
            number, size = number + 1, 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for doc, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(blob, dtype)
                if held and size + len(x) > BLOCK_TOKENS:
                    yield flush()
                for lo in range(0, len(x), BLOCK_TOKENS):
                    piece = x[lo:lo + BLOCK_TOKENS]
                    held.append((doc, ordinal, done + lo, piece))
                    size += len(piece)
                    if size >= BLOCK_TOKENS:
                        yield flush()
                done += len(x)
                ordinal += 1
        if held:
            yield flush()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id"), F.xxhash64("ids")]
    (ids.repartitionByRange(parts, *order).sortWithinPartitions(*order)
     .mapInArrow(blocks, "shard long, block long, n_tokens long, payload binary, doc_ids array<long>, ordinals array<long>, starts array<long>, lengths array<long>")
     .write.option("parquet.block.size", 8 << 20).option("compression", "none").parquet(f"{path}/blocks"))
    release(spark, ids_path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the container at ``path``."""
    freq = np.asarray([r["freq"] for r in spark.read.parquet(f"{path}/table").orderBy("id").collect()])
    shared = spark.sparkContext.broadcast(freq)
    rows = spark.read.parquet(f"{path}/blocks")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").toPandas()
    base = pd.DataFrame({"shard": totals["shard"].astype("int64"), "base": totals["n"].cumsum().shift(fill_value=0).astype("int64")})

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_caches()
        table = rans.Table(shared.value)
        for batch in batches:
            for r in batch.to_pylist():
                ids = rans.decode(r["payload"], table).astype("<u4")
                ends = np.cumsum(r["lengths"])
                yield pa.RecordBatch.from_pydict({
                    "shard": [r["shard"]] * len(ends), "ordinal": r["ordinals"], "doc_id": pa.array(r["doc_ids"], pa.int64()), "start": r["starts"], "n": r["lengths"],
                    "crc": [zlib.crc32(ids[e - n:e].data) for e, n in zip(ends.tolist(), r["lengths"], strict=True)]})

    parts = rows.select("shard", "payload", "doc_ids", "ordinals", "starts", "lengths").mapInArrow(part, "shard long, ordinal long, doc_id long, start long, n long, crc long")
    docs = parts.groupBy("shard", "ordinal", "doc_id").agg(F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("start", "n", "crc"))).alias("parts"))

    @F.pandas_udf("long")
    def join_parts(col: pd.Series) -> pd.Series:
        out = []
        for ps in col:
            crc = 0
            for i, p in enumerate(ps):
                crc = int(p["crc"]) if not i else crc_join(crc, int(p["crc"]), 4 * int(p["n"]))
            out.append(crc)
        return pd.Series(out, dtype="int64")

    if base.empty:
        return docs.select("doc_id", "start", "n_tokens", F.lit(0).cast("long").alias("ids_crc32"))
    # one row per shard: bounded by the number of write tasks
    docs = docs.join(F.broadcast(spark.createDataFrame(base)), "shard")
    crc = F.when(F.size("parts") == 1, F.col("parts")[0]["crc"]).otherwise(join_parts(F.when(F.size("parts") > 1, F.col("parts")).otherwise(F.slice("parts", 1, 0))))
    return docs.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", crc.alias("ids_crc32"))


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"), path)
    return read_tokens(spark, path)
