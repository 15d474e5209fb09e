"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A disguised word (leetspeak, spaced letters, repeated letters) is a lattice of letters. Viterbi decoding finds the likeliest path under a
character trigram model, which is counted over all texts, times the channel's penalties. The restored words join the text's own.

The score is learned from labelled rows: every word and word stem (its first 3 to 6 letters) gets the lower confidence bound of its log odds
between toxic and other documents; a document's score is a logistic function of its strongest features. Labels are a bounded sample: at most
about FIT_ROWS of each class, chosen by a hash of the id. All statistics of the language model cover all rows.

Edge cases: null and empty texts have no feature and get the score of a text without any; documents without a label are scored, not learned from;
null labels are ignored; of repeated labels of a document the largest counts. Without both classes every score is 0. Scores depend on the text only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import U, crc_of, forget_caches, materialize, pack_counts, plain, prefix_hash, release, span_hash, sum_counts, unpack_counts
from cohortspark.llm.language import _letters, _steps

FIT_ROWS = 10_000
NGRAM_BITS = 18
STEMS = (3, 4, 5, 6)
#: Restored words longer than this are not kept in the dictionary.
LONG_TOKEN = 100
#: Characters that stand for letters in disguised words.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou"}
SUBSTITUTE, COLLAPSE = -1.0, -0.5
_MARKS = re.compile(r"(?<=[^\W\d_])[0-9@$!|+(€*]+(?=[^\W\d_])|(?<!\S)[0-9@$!|+(€]+(?=[^\W\d_])|(?<=[^\W\d_])[0-9@$]+(?![^\s.,;:!?])")
_GAP = re.compile(r"\s")
_REPEAT = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*/]{1,2}(?=[^\W_](?![^\W_]))[^\W_]){2,}")


# ---------------------------------------------------------------- character model

def char_counts(texts: DataFrame) -> np.ndarray:
    """Trigram and bigram counts (two rows of hashed slots) over all rows of ``texts`` (text)."""
    size = 2 << NGRAM_BITS

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        forget_caches()
        total = np.zeros(size, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in _steps(texts):
                cp = code_points(texts[lo:hi])[0]
                total[:size // 2] += np.bincount(slot(cp[:-2], cp[1:-1], cp[2:]), minlength=size // 2)
                total[size // 2:] += np.bincount(slot(cp[:-1], cp[1:]), minlength=size // 2)
        yield pa.RecordBatch.from_pydict({"salt": [TaskContext.get().partitionId()], "counts": [pack_counts(total)]})

    rows = sum_counts(texts.select("text").mapInArrow(part, "salt long, counts binary"), [], size).collect()
    total = sum((unpack_counts(r["counts"], np.int64) for r in rows), np.zeros(size, np.int64))
    return total.reshape(2, -1)


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased letters and spaces of the texts, three spaces after each; start of each text)."""
    lower = [(x or "").lower() for x in texts]
    joined = "   ".join(lower) + "   "
    cp = _letters()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    return cp, np.concatenate([[0], np.cumsum([len(x) + 3 for x in lower])])[:-1]


def slot(*columns: np.ndarray) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h + c.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(31)
    return (h >> U(64 - NGRAM_BITS)).astype(np.int64)


class CharModel:
    """Log probabilities of a letter after two others, looked up one by one and remembered."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.known = counts, {}

    def __call__(self, a: str, b: str, c: str) -> float:
        key = a + b + c
        if key not in self.known:
            x, y, z = (np.asarray([ord(k)], np.uint32) for k in key)
            n3, n2 = int(self.counts[0][slot(x, y, z)[0]]), int(self.counts[1][slot(x, y)[0]])
            self.known[key] = math.log((min(n3, n2) + 0.05) / (n2 + 2.0))
        return self.known[key]


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of a character: the letters it may stand for, with the channel's penalty."""
    out = []
    for m in re.finditer(r"(.)\1*", token.lower(), re.S):
        c, n = m[1], len(m[0])
        if c.isalpha():
            out.append([(c * n, 0.0)] if n < 3 else [(c, COLLAPSE), (c * 2, COLLAPSE)])
        elif c in LEET:
            out.append([(x * k, SUBSTITUTE * k) for x in LEET[c] for k in ({1} if n == 1 else {1, 2})])
        # other characters separate letters and vanish
    return out


def decode(token: str, model) -> str:
    """The likeliest letters behind a disguised word (Viterbi over states of two letters); of equal ones the greatest text."""
    start = (None, "")
    beam: dict[str, tuple[float, tuple]] = {"  ": (0.0, start)}  # state: score, way (the way before, its last letters)
    for options in [*lattice(token), [(" ", 0.0)]]:
        nxt: dict[str, tuple[float, tuple]] = {}
        for state, (score, way) in beam.items():
            for letters, cost in options:
                s, now = score + cost, state
                for c in letters:
                    s += model(now[0], now[1], c)
                    now = now[1] + c
                if now not in nxt or s > nxt[now][0]:
                    nxt[now] = (s, (way, letters))
        beam = nxt
    top = max(score for score, _ in beam.values())
    return max(_spelled(way) for score, way in beam.values() if score == top).strip()


def _spelled(way: tuple) -> str:
    out = []
    while way[0] is not None:
        way, letters = way
        out.append(letters)
    return "".join(reversed(out))


def disguised(text: str) -> list[str]:
    """Stretches of the text that may be disguised words, each once; the work is linear in the text."""
    spans, end = [], -1
    for m in sorted((m.span() for pattern in (_MARKS, _REPEAT) for m in pattern.finditer(text))):
        if m[0] < end:
            continue  # the word around an earlier match holds this one too
        a = m[0]
        while a > max(end, 0) and not text[a - 1].isspace():
            a -= 1
        found = _GAP.search(text, m[1])
        end = found.start() if found else len(text)
        spans.append((a, end))
    out = []
    for a, b in spans:
        token = text[a:b].strip(".,;:?\"'()[]{}<>#%&=")
        token = re.sub(r"([^\w\s])\1\1+$|^([^\w\s])\2\2+", "", token)
        if token and (any(c in LEET for c in token) or _REPEAT.search(token)) and any(c.isalpha() for c in token):
            out.append(token)
    for m in _SPACED.finditer(text):
        out.append(m[0])
    return out


class Restorer:
    """Restored words of texts; decoded tokens are kept in a bounded dictionary."""

    def __init__(self, counts: np.ndarray, size: int = 200_000):
        self.model, self.known, self.size = CharModel(counts), {}, size

    def words(self, text: str | None) -> str:
        if not text:
            return ""
        out = []
        for token in disguised(text):
            if len(token) > LONG_TOKEN:  # not a word that comes again
                out.append(decode(token, self.model))
                continue
            if token not in self.known:
                if len(self.known) >= self.size:
                    self.known.clear()
                self.known[token] = decode(token, self.model)
            out.append(self.known[token])
        return " ".join(out)


# ---------------------------------------------------------------- features and score

def text_features(texts: list[str | None], restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """(hashed feature, text number) of every word and stem of the texts and their restored words."""
    full = [f"{x or ''} {restorer.words(x)}" for x in texts]
    cp, begin = code_points(full)
    letter = cp != 32
    s, e = letter.copy(), letter.copy()
    s[1:] &= ~letter[:-1]
    e[:-1] &= ~letter[1:]
    start, end = np.flatnonzero(s), np.flatnonzero(e) + 1
    doc = np.searchsorted(begin, start, "right") - 1
    sums = prefix_hash(cp)
    hashes, docs = [span_hash(sums, start, end)], [doc]
    for n in STEMS:
        long = end - start > n
        hashes.append(span_hash(sums, start[long], start[long] + n, n))
        docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs)


class Lexicon:
    """Feature weights, found by binary search in the sorted hashes; a table of hash prefixes rules out most others first."""

    def __init__(self, features: np.ndarray, weights: np.ndarray):
        order = np.argsort(features, kind="stable")
        self.keys, self.weights = features[order], weights[order].astype(np.float32)
        self.bits = max(16, int(len(features) * 8).bit_length())
        self.prefix = np.zeros(1 << self.bits, bool)
        self.prefix[(self.keys >> U(64 - self.bits)).astype(np.int64)] = True

    def strongest(self, hashes: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
        """The weight of each text's strongest feature, 0 without any."""
        maybe = np.flatnonzero(self.prefix[(hashes >> U(64 - self.bits)).astype(np.int64)])
        out = np.zeros(n)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == hashes[maybe]
            np.maximum.at(out, docs[maybe[hit]], self.weights[at[hit]])
        return out


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of a bounded sample of the labelled rows that are not held out."""
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = rows.where(F.pmod(crc_of("doc_id"), F.lit(5)) != 0)
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    every = F.when(F.col("toxic") == 1, max(1, round(size.get(1, 0) / FIT_ROWS))).otherwise(max(1, round(size.get(0, 0) / FIT_ROWS)))
    # about 2 FIT_ROWS rows of two numbers: bounded whatever the table
    return docs.join(F.broadcast(rows.where(F.pmod(F.xxhash64("doc_id"), every) == 0)), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, counts) -> tuple[Lexicon, float, float] | None:
    """(feature weights, slope, intercept), or None without both classes."""
    # the salt deals equal texts and repeated ids to different tasks; it is written with the rows, so that it stays the same
    sample, path = materialize(labelled(docs, labels).select("doc_id", "text", "toxic", F.monotonically_increasing_id().alias("salt")), "labelled")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(size) != {0, 1}:
        return None
    bad, good = size[1], size[0]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(counts.value)
        for batch in batches:
            texts, toxic, fold = batch.column(0).to_pylist(), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for lo in range(0, len(texts), 200):
                h, doc = text_features(texts[lo:lo + 200], restorer)
                both = np.unique(np.rec.fromarrays([h, doc], names="h,d"))
                f, inverse = np.unique(both["h"], return_inverse=True)
                kind = (2 * fold + toxic)[lo:lo + 200][both["d"]]
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), *[pa.array(np.bincount(inverse, kind == k, len(f)).astype(np.int64)) for k in range(4)]],
                                                 names=["feature", "b0", "a0", "b1", "a1"])

    # documents of one half are scored with weights from the other half to fit the logistic function
    half = sample.select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).alias("fold"), "salt")
    seen = half.repartition(16, "salt").drop("salt").mapInArrow(part, "feature long, b0 long, a0 long, b1 long, a1 long")
    seen = seen.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("a0", "b0", "a1", "b1")]).where("a0 + a1 >= 3").toPandas()

    def lexicon_of(a: np.ndarray, b: np.ndarray, share: float) -> Lexicon:
        a, b = a + 0.5, b + 0.5
        w = np.log(a / (bad * share + 1)) - np.log(b / (good * share + 1)) - 1.64 * np.sqrt(1 / a + 1 / b)
        keep = (w > 0.5) & (a >= 3)
        return Lexicon(seen["feature"].to_numpy(np.int64).view(np.uint64)[keep], w[keep])

    a0, b0, a1, b1 = (seen[c].to_numpy(float) for c in ("a0", "b0", "a1", "b1"))
    lexicon, halves = lexicon_of(a0 + a1, b0 + b1, 1.0), (lexicon_of(a1, b1, 0.5), lexicon_of(a0, b0, 0.5))
    shared = docs.sparkSession.sparkContext.broadcast((counts.value, halves))

    def strength(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, halves = shared.value
        restorer = Restorer(counts)
        for batch in batches:
            texts, toxic, fold = batch.column(0).to_pylist(), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for lo in range(0, len(texts), 200):
                h, doc = text_features(texts[lo:lo + 200], restorer)
                n = len(texts[lo:lo + 200])
                x = np.where(fold[lo:lo + 200] == 0, halves[0].strongest(h, doc, n), halves[1].strongest(h, doc, n))
                yield pa.RecordBatch.from_pydict({"x": pa.array(x), "y": pa.array(toxic[lo:lo + 200].astype(np.int64))})

    xy = half.drop("salt").mapInArrow(strength, "x double, y long").toPandas()
    release(docs.sparkSession, path)
    x, y = xy["x"].to_numpy(), xy["y"].to_numpy(float)
    slope, intercept = 0.0, 0.0
    for _ in range(50):  # Newton's method with a little shrinkage
        p = 1 / (1 + np.exp(-(slope * x + intercept)))
        g = np.array([((y - p) * x).sum() - 0.1 * slope, (y - p).sum() - 0.01 * intercept])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        slope, intercept = slope + step[0], intercept + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return lexicon, float(slope), float(intercept)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Append score (0 to 1) and predicted (1 from 0.5 on) to every row of ``docs``; ``labels`` has doc_id and toxic."""
    sc = docs.sparkSession.sparkContext
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    counts = sc.broadcast(char_counts(base))
    model = fit(base, labels.select("doc_id", "toxic"), counts)
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    shared = sc.broadcast((counts.value, *model))

    @F.pandas_udf("double")
    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts, lexicon, slope, intercept = shared.value
        restorer = Restorer(counts)
        for s in series:
            texts = [x if isinstance(x, str) else None for x in s]
            out = np.zeros(len(texts))
            for lo, hi in _steps(texts):
                h, doc = text_features(texts[lo:hi], restorer)
                out[lo:hi] = lexicon.strongest(h, doc, hi - lo)
            yield pd.Series(1 / (1 + np.exp(-(slope * out + intercept))))

    out = docs.withColumn("score", score(F.col(f"`{text_col}`")))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    scored = score_documents(docs, plain(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "toxic"))
    return scored.select("doc_id", (F.pmod(crc_of("doc_id"), F.lit(5)) == 0).alias("held_out"), "score", "predicted")
