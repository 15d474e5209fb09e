"""Text → vector.

Default encoder (E4): signed feature hashing. Each token's bucket and sign come
from its md5; ``hashed_long`` states it in SQL expressions (tokens exploded,
counts summed per row and bucket), ``hashed_embedding`` gives the dense
vectors in the row. The result has the reference's output type (``array<float>``, one fixed
dimension, unnormalised by default) but is not numerically a transformer
embedding. A user with a model describes it as a :class:`TextEncoder`, which
training, artifacts, scoring and streams then use in Arrow batches inside the
executors (built once per Python worker).
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.numeric import l2_normalize
from cohortspark.schema import TEXT_EMBEDDING_BATCH_SIZE, TEXT_EMBEDDING_MAX_LENGTH, TEXT_EMBEDDING_NORMALIZE

DEFAULT_DIM = 384
HASHING = "signed-hashing"
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
_TOKEN = re.compile(r"[^\W_]+")  # the same runs of letters and digits
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only (identical in every engine, unlike Unicode case maps)."""
    return F.translate(c, _UPPER, _UPPER.lower())


def tokens(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT), lambda t: t != "")


def hashed_long(df: DataFrame, key_cols: Sequence[str], text_col: str, *,
                dim: int = DEFAULT_DIM) -> DataFrame:
    """``(key…, bucket, value)``: signed token counts per hash bucket (zeros dropped)."""
    ex = df.select(*key_cols, F.explode(tokens(F.col(text_col))).alias("tok"))
    h = F.md5("tok")
    ex = ex.select(*key_cols,
                   F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int").alias("bucket"),
                   F.when(F.substring(h, 9, 1) < F.lit("8"), F.lit(1.0)).otherwise(F.lit(-1.0)).alias("s"))
    return (ex.groupBy(*key_cols, "bucket").agg(F.sum("s").alias("value"))
              .where(F.col("value") != 0))


#: Codes of tokens that this Python worker has hashed: 2 * first 32 bits of the md5 + (1 if the sign is negative).
_CODES: dict[str, int] = {}
MAX_CODES = 500_000


class _Hash(dict):
    """A dictionary that hashes a token when it is first asked for."""

    def __missing__(self, token: str) -> int:
        d = hashlib.md5(token.encode("utf-8")).digest()
        self[token] = code = int.from_bytes(d[:4], "big") << 1 | d[4] >> 7
        return code


#: ASCII letters lower-cased, digits kept, all else blanks.
_ASCII = {i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)}


def _words(text: str) -> list[str]:
    """Runs of letters and digits, A-Z lower-cased; ASCII texts need no pattern."""
    return text.translate(_ASCII).split() if text.isascii() else _TOKEN.findall(text.encode().lower().decode())  # bytes.lower(): A-Z only


def _batch_vectors(texts: Sequence[str | None], dim: int, normalize: bool) -> np.ndarray:
    """Dense signed-hash counts for a batch of texts: each distinct token is hashed once, one ``bincount`` adds all up."""
    global _CODES
    if not isinstance(_CODES, _Hash) or len(_CODES) > MAX_CODES:
        _CODES = _Hash()
    code_of, n = _CODES.__getitem__, len(texts)
    codes = [list(map(code_of, _words(t))) if t else [] for t in texts]
    sizes = np.fromiter(map(len, codes), np.int64, n)
    flat = np.fromiter(chain.from_iterable(codes), np.int64, int(sizes.sum()))
    at = np.repeat(np.arange(n), sizes) * dim + (flat >> 1) % dim
    mat = np.bincount(at, weights=1.0 - 2.0 * (flat & 1), minlength=n * dim).reshape(n, dim)
    if normalize:
        mat = mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-12)
    return mat


def _hash_vectors_udf(dim: int, normalize: bool):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def dense(texts: pd.Series) -> pd.Series:
        out = []
        for lo in range(0, len(texts), 1000):  # codes of 1000 texts at a time
            out.extend(_batch_vectors([t if isinstance(t, str) else None for t in texts.iloc[lo:lo + 1000]], dim, normalize).astype(np.float32))
        return pd.Series(out, dtype=object)
    return dense


def hashed_embedding(df: DataFrame, key_cols: Sequence[str] | None, text_col: str, *,
                     dim: int = DEFAULT_DIM, normalize: bool = False,
                     out_col: str = "embedding") -> DataFrame:
    """Dense ``array<float>`` per row, computed inside the row: no shuffle, no join.

    Texts travel once, as they are; a worker splits them into runs of letters
    and digits and keeps the hashes of the tokens it has met. Same values as
    summing :func:`hashed_long` per row. ``key_cols`` is accepted for API symmetry.
    """
    return df.withColumn(out_col, _hash_vectors_udf(dim, normalize)(F.col(text_col)))


@dataclass(frozen=True)
class TextEncoder:
    """A pluggable text encoder.

    ``build`` receives the local paths of ``files`` by base name and returns an object with
    ``encode(texts, max_length) -> (n, dim)``. It is called once in the life of a Python worker. ``files`` (weights,
    vocabularies) are shipped to the executors with ``addFile``. ``max_length`` is handed on to the encoder.
    """
    encoder_id: str
    dim: int
    build: Callable[[dict[str, str]], object]
    files: tuple[str, ...] = ()
    batch_size: int = TEXT_EMBEDDING_BATCH_SIZE
    max_length: int | None = TEXT_EMBEDDING_MAX_LENGTH
    normalize: bool = TEXT_EMBEDDING_NORMALIZE


#: Encoders that artifacts may name; filled on the driver by ``register_encoder``.
ENCODERS: dict[str, TextEncoder] = {}
#: Encoders built in this Python worker, and how often each was built.
_BUILT: dict[tuple, object] = {}
BUILDS: Counter = Counter()


def register_encoder(encoder: TextEncoder) -> TextEncoder:
    """Make an encoder known by its id, to training, artifacts, scoring and streams."""
    if encoder.encoder_id in (HASHING, "none"):
        raise ValueError(f"{encoder.encoder_id!r} is a reserved name")
    ENCODERS[encoder.encoder_id] = encoder
    return encoder


def worker_encoder(encoder: TextEncoder):
    """The built encoder of this worker process."""
    key = (encoder.encoder_id, encoder.files)
    if key not in _BUILT:
        names = [os.path.basename(f) for f in encoder.files]
        _BUILT[key] = encoder.build({n: SparkFiles.get(n) for n in names})
        BUILDS[encoder.encoder_id] += 1
    return _BUILT[key]


def encode_batch(encoder: TextEncoder, texts: Sequence[str]) -> np.ndarray:
    """Vectors of the texts in their order; texts of like length share a batch, so that padding is short."""
    out = np.zeros((len(texts), encoder.dim), np.float32)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    model = worker_encoder(encoder)
    for lo in range(0, len(order), encoder.batch_size):
        rows = order[lo:lo + encoder.batch_size]
        v = np.asarray(model.encode([texts[i] for i in rows], encoder.max_length), np.float32)
        if v.shape != (len(rows), encoder.dim):
            raise ValueError(f"encoder {encoder.encoder_id!r} returned {v.shape} for {len(rows)} texts of {encoder.dim} dimensions")
        out[rows] = v
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12) if encoder.normalize else out


def embed_with_encoder(df: DataFrame, text_col: str, encoder: TextEncoder, *, out_col: str = "embedding") -> DataFrame:
    """Append the encoder's vectors (null texts are empty); no shuffle, all columns stay."""
    sc = df.sparkSession.sparkContext
    here = set(sc.listFiles)
    for f in encoder.files:
        if os.path.basename(f) not in {os.path.basename(x) for x in here}:
            sc.addFile(f)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encode_batch(encoder, texts.tolist())), dtype=object)
    return df.withColumn(out_col, encode(F.coalesce(F.col(text_col), F.lit(""))))


def text_embedding(df: DataFrame, text_col: str, model_name: str, *, dim: int, out_col: str = "embedding") -> DataFrame:
    """The text vector that a manifest names: the hashed one or a registered encoder's."""
    if model_name == HASHING:
        return hashed_embedding(df, None, text_col, dim=dim, out_col=out_col)
    if model_name not in ENCODERS:
        raise KeyError(f"text encoder {model_name!r} is not registered (register_encoder)")
    if ENCODERS[model_name].dim != dim:
        raise ValueError(f"text encoder {model_name!r} has {ENCODERS[model_name].dim} dimensions, the manifest {dim}")
    return embed_with_encoder(df, text_col, ENCODERS[model_name], out_col=out_col)


def mean_pool(token_vectors: Column, mask: Column, floor: float = 1e-9) -> Column:
    """masked mean of token vectors (``array<array<double>>`` + ``array<int>``)."""
    dim = F.size(F.element_at(token_vectors, 1))
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m.cast("double")), F.lit(floor))
    # one walk over the tokens; each adds its vector to the running sums
    summed = F.aggregate(F.arrays_zip(token_vectors.alias("v"), mask.alias("m")), F.array_repeat(F.lit(0.0), dim), lambda acc, e: F.zip_with(
        acc, e["v"], lambda a, x: a + x.cast("double") * e["m"].cast("double")))
    return F.transform(summed, lambda x: x / count)
