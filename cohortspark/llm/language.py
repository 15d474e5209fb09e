"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else counts as a space; the n-grams of 1 to 3 characters are hashed into
``BUCKETS`` features. Counts by language are summed on the executors, the log-probability matrix (languages x
features, size-checked) is broadcast, and texts are scored in numpy batch by batch.

Edge cases: null texts, and texts without a letter, get ``und`` and score 0. Rows with a null language are not
learned from but are predicted. Without any learnable row every text is ``und``. Equal posteriors: the first language
in alphabetical order. Repeated rows count as often as they stand there; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import U, crc_of, pack_counts, plain, sum_counts, unpack_counts

BUCKETS = 1 << 15
#: Largest matrix (bytes) that is broadcast; it grows with the number of languages, not with the rows.
MATRIX_BYTES = 64 << 20
STEP_CHARS = 1 << 20
_TABLE: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else a space."""
    if "t" not in _TABLE:
        n = 0x110000
        t = np.full(n, 32, np.uint32)
        t[[c for c in range(n) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = 1
        _TABLE["t"] = np.where(t == 1, np.arange(n, dtype=np.uint32), np.uint32(32))
    return _TABLE["t"]


def grams(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(buckets of 1-, 2- and 3-grams at each character, start of each text, whether it has a letter).

    Three spaces stand after each text, so that no n-gram crosses into the next one.
    """
    joined = "".join([(x or "") + "   " for x in texts]).lower()
    if "\ud800" <= max(joined, default="") :  # lone surrogates cannot be encoded
        joined = "".join(" " if "\ud800" <= c <= "\udfff" else c for c in joined)
    sizes = [len((x or "").lower()) + 3 for x in texts]
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    cp = _letters()[cp].astype(np.uint64)
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    letter = np.add.reduceat(cp != 32, begin) > 0
    pad = np.concatenate([cp, np.full(2, 32, np.uint64)])
    out, h = [], np.zeros(len(cp), np.uint64)
    last = np.cumsum(sizes) - 1
    for k in range(3):
        ahead = pad[k:k + len(cp)].copy()
        for back in range(k):
            ahead[last - back] = 32  # what stands behind a text's spaces is the next text
        h = (h + ahead) * U(0x9E3779B97F4A7C15) + U(k + 1)
        out.append(((h ^ (h >> U(29))) * U(0xD6E8FEB86659FD93) >> U(49)).astype(np.int32))
    return out, begin, letter


def _steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size > STEP_CHARS:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, counts) of the n-grams in ``rows`` (text, lang), one packed vector per language; slot BUCKETS counts the texts."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in _steps(texts):
                g, begin, _ = grams(texts[lo:hi])
                names = sorted(set(langs[lo:hi]))
                code = np.searchsorted(names, langs[lo:hi])
                per = np.repeat(code, np.diff(np.append(begin, len(g[0])))).astype(np.int64) * BUCKETS
                total = np.zeros(len(names) * BUCKETS, np.int64)
                for x in g:
                    total += np.bincount(per + x, minlength=len(total))
                for i, name in enumerate(names):
                    s = sums.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    s[:-1] += total[i * BUCKETS:(i + 1) * BUCKETS]
                    s[-1] += int((code == i).sum())
        if sums:
            salt = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "salt": [salt] * len(sums), "counts": [pack_counts(s) for s in sums.values()]})

    partials = plain(rows, "text", "lang").mapInArrow(part, "lang string, salt long, counts binary")
    return sum_counts(partials, ["lang"], BUCKETS + 1)


def fit(rows: DataFrame, alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability matrix of BUCKETS + 1 rows, the last one the log priors)."""
    found = sorted((r["lang"], unpack_counts(r["counts"], np.int64)) for r in count_grams(rows).collect())
    if (BUCKETS + 1) * 4 * len(found) > MATRIX_BYTES:
        raise ValueError(f"{len(found)} languages: the matrix would pass MATRIX_BYTES; use fewer BUCKETS")
    if not found:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    counts = np.stack([c for _, c in found], 1).astype(float)
    logp = np.log((counts[:-1] + alpha) / (counts[:-1].sum(0) + alpha * BUCKETS))
    prior = np.log((counts[-1] + 1) / (counts[-1].sum() + len(found)))
    return [n for n, _ in found], np.vstack([logp, prior]).astype(np.float32)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """Append lang_pred and score (the winner's posterior, 0 to 1) to ``df``."""
    langs, matrix = model
    shared = df.sparkSession.sparkContext.broadcast(matrix)

    @F.pandas_udf("lang string, score double")
    def guess(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in series:
            texts = [x if isinstance(x, str) else None for x in s]
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            for lo, hi in _steps(texts) if langs else ():
                g, begin, letter = grams(texts[lo:hi])
                total = np.tile(m[-1].astype(float), (hi - lo, 1))
                for c in range(len(langs)):
                    column = np.ascontiguousarray(m[:-1, c])
                    for x in g:
                        total[:, c] += np.add.reduceat(column[x], begin, dtype=np.float64)
                top = total.argmax(1)
                post = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                for i in np.flatnonzero(letter):
                    names[lo + i], scores[lo + i] = langs[top[i]], min(1.0, post[i])
            yield pd.DataFrame({"lang": names, "score": scores})

    out = df.withColumn("_guess", guess(F.col(f"`{text_col}`")))
    return out.withColumns({"lang_pred": F.col("_guess.lang"), "score": F.col("_guess.score")}).drop("_guess")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.pmod(crc_of("doc_id"), F.lit(4)) == 2)
    model = fit(docs.where(~F.col("held_out") & F.col("lang").isNotNull()))
    return predict(plain(docs, "doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")
