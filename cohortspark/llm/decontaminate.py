"""Benchmark decontamination: latent semantic retrieval of passages, then longest-common-subsequence and answer checks.

Words (of lower-cased texts) are hashed into FEATURES TF-IDF features; document frequencies are counted over all documents. A randomised SVD, computed as
distributed passes of A'(A Q), gives a latent space of RANK dimensions. It is fitted on all passages of all documents (the same words
count once) and all benchmark passages; the corpus weighs as FIT_DOCS passages, however many it has, so that the benchmark keeps its share of the
space. The documents' features are written once, two bytes a word, and every pass reads those. Every passage of every document (64 words, every 32
words) is projected and compared with every benchmark passage by cosine (with the passage's length before projection, so that what the
latent space cannot hold counts against it). What a space of that rank cannot tell apart, the more the more items there are, comes from an exact
path beside it: an item's rarest words up to KEY_SHARE of its weight are its keys, a region without enough of their weight cannot reach
IDF_SHARE, and every passage whose region has enough is a candidate as well. Latent candidates whose surroundings lack too many of the item's rare words to pass are left out by sums. Each other candidate is then checked on the words themselves: the longest
common subsequence of the item and the surrounding text must hold LCS_SHARE of the item's words, the words found must carry
IDF_SHARE of its idf weight, and an item with an answer must have that answer's words in a row near by. So paraphrases that replace, drop
or insert some words are found.

The benchmark is cut into parts of bounded size; each part has its own latent space and pass over the documents.

Edge cases: null texts are empty; documents and items without words match nothing; items of fewer than SHORT words must be found whole
and in a row. Repeated items and documents are judged alike. An empty benchmark or table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import U, materialize, pack_counts, plain, release, sum_counts, text_steps, unpack_counts, word_hashes
from cohortspark.session import shuffles_end_with_jobs

FEATURE_BITS = 15
FEATURES = 1 << FEATURE_BITS
RANK, OVERSAMPLE, POWER_PASSES, FIT_DOCS = 64, 16, 2, 4096
HALF = 32
RARE = 2.5
COSINE, LCS_SHARE, IDF_SHARE, SHORT = 0.15, 0.6, 0.6, 8
#: Share of an item's idf weight that its keys hold; over 1 - IDF_SHARE, so that a region that passes holds some of them.
KEY_SHARE = 0.7
#: Bytes of benchmark text that one pass works on at most.
PART_BYTES = 4 << 20
_STEP = 1 << 18
#: Bytes of written features that a step of a fit handles, and the words whose rows of a basis are fetched at a time (they stay in the cache).
_WINDOW, _FETCH = 1 << 20, 1 << 10
#: Features of a basis that the driver handles at a time.
_SLICE = 1 << 11


def feature(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - FEATURE_BITS)).astype(np.int64)


def _cut(steps):
    for batch, data, offsets in steps:
        for lo in range(0, len(offsets) - 1, 60_000):
            o = offsets[lo:lo + 60_001]
            yield batch.slice(lo, len(o) - 1), data[o[0]:o[-1]], o - o[0]


def word_features(texts: DataFrame) -> DataFrame:
    """The features of the words of each row of ``texts`` (text), in order, as 16-bit numbers."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in _cut(text_steps(batches, "text", _STEP, lower=True)):
            h, first = word_hashes(data, offsets)
            blob = feature(h).astype("<u2").tobytes()
            yield pa.RecordBatch.from_pydict({"features": pa.array([blob[2 * a:2 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())})

    return texts.select("text").mapInArrow(part, "features binary")


def _feature_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, features of its rows' words back to back, words of each row)."""
    for batch, data, offsets in _cut(text_steps(batches, "features", _WINDOW)):
        yield batch, data.view("<u2"), np.diff(offsets) // 2


def document_frequency(words: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold a word of each feature, number of documents) over all rows of ``words`` (features)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total = np.zeros(FEATURES + 1, np.int64)
        for _, f, n in _feature_steps(batches):
            key = np.sort((np.repeat(np.arange(len(n), dtype=np.int64), n) << FEATURE_BITS) | f)
            key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
            total[:-1] += np.bincount(key & (FEATURES - 1), minlength=FEATURES)
            total[-1] += len(n)
        yield pa.RecordBatch.from_pydict({"salt": [TaskContext.get().partitionId()], "counts": [pack_counts(total)]})

    rows = sum_counts(words.select("features").mapInArrow(part, "salt long, counts binary"), [], FEATURES + 1).collect()
    total = sum((unpack_counts(r["counts"], np.int64) for r in rows), np.zeros(FEATURES + 1, np.int64))
    return total[:-1], int(total[-1])


def passages(n: int) -> np.ndarray:
    """First words of the passages of a text of ``n`` words: every HALF words, the last one full if it can be."""
    if n <= 2 * HALF:
        return np.zeros(min(n, 1), np.int64)
    starts = np.arange(0, n - 2 * HALF, HALF)
    return np.append(starts, n - 2 * HALF)


class Blocks:
    """Texts of ``n`` words each, back to back, in blocks of HALF words; a passage is two blocks in a row, or a text's only block."""

    def __init__(self, n: np.ndarray):
        blocks = -(-n // HALF)
        self.doc = np.repeat(np.arange(len(n)), blocks)
        first = np.concatenate([[0], np.cumsum(n)])
        self.start = first[self.doc] + (np.arange(len(self.doc)) - (np.cumsum(blocks) - blocks)[self.doc]) * HALF
        self.stop = np.minimum(self.start + HALF, first[self.doc + 1])
        goes_on = np.r_[self.doc[1:] == self.doc[:-1], False] if len(self.doc) else np.zeros(0, bool)
        #: First block of each passage, and the passages that have a second one.
        self.lead = np.flatnonzero(goes_on | (blocks[self.doc] == 1))
        self.two = np.flatnonzero(goes_on[self.lead])
        self.passages = np.bincount(self.doc[self.lead], minlength=len(n))

    def scale(self, f: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """What brings each passage's TF-IDF row to unit length, given the words' features."""
        none = len(self.lead)
        own, before = np.full(len(self.doc), none), np.full(len(self.doc), none)
        own[self.lead] = np.arange(none)
        before[self.lead[self.two] + 1] = self.two
        size = self.stop - self.start
        key = np.concatenate([np.repeat(own, size), np.repeat(before, size)]) << FEATURE_BITS | np.tile(f, 2)
        key = np.sort(key[key >> FEATURE_BITS < none])
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
        w = np.diff(np.append(cut, len(key))) * idf[key[cut] & (FEATURES - 1)]
        return (1 / np.maximum(np.sqrt(np.bincount(key[cut] >> FEATURE_BITS, w * w, none)), 1e-12)).astype(np.float32)


def block_sums(q: np.ndarray, f: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the words' rows of ``q`` over blocks of at most HALF words that lie back to back, given their first words."""
    out, rows = np.empty((len(start), q.shape[1]), np.float32), np.empty((_FETCH, q.shape[1]), np.float32)
    step = _FETCH // HALF
    for lo in range(0, len(out), step):
        at = start[lo:lo + step]
        mine = f[at[0]:start[lo + step] if lo + step < len(out) else len(f)]
        np.take(q, mine, axis=0, out=rows[:len(mine)], mode="clip")
        np.add.reduceat(rows[:len(mine)], at - at[0], out=out[lo:lo + step])
    return out


def _add_rows(total: np.ndarray, f: np.ndarray, row: np.ndarray, u: np.ndarray) -> None:
    """Add ``u[row]`` to the rows ``f`` of ``total``, which is walked through once."""
    by = np.argsort(f, kind="stable")
    f, row = f[by], row[by]
    first = np.r_[True, f[1:] != f[:-1]]
    rows = np.empty((_FETCH, u.shape[1]), np.float32)
    for lo in range(0, len(f), _FETCH):
        cut = np.flatnonzero(first[lo:lo + _FETCH])
        cut = cut if len(cut) and not cut[0] else np.r_[0, cut]
        mine = row[lo:lo + _FETCH]
        np.take(u, mine, axis=0, out=rows[:len(mine)], mode="clip")
        total[f[lo + cut]] += np.add.reduceat(rows[:len(mine)], cut)


def fit_rows(words: DataFrame, idf: np.ndarray) -> DataFrame:
    """(features, scale, passages): each list of words once, with what brings its passages to unit length."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, f, n in _feature_steps(batches):
            blocks = Blocks(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), *_scale_columns(blocks, f, idf)], names=["features", "scale", "passages"])

    return words.select("features").where(F.octet_length("features") > 0).dropDuplicates().mapInArrow(part, "features binary, scale binary, passages long")


def _scale_columns(blocks: Blocks, f: np.ndarray, idf: np.ndarray) -> tuple[pa.Array, pa.Array]:
    blob, ends = blocks.scale(f, idf).astype("<f4").tobytes(), np.cumsum(blocks.passages).tolist()
    return pa.array([blob[4 * a:4 * b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary()), pa.array(blocks.passages, pa.int64())


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A'B in double precision, from slices of two single-precision matrices."""
    return sum(a[lo:lo + _SLICE].T.astype(float) @ b[lo:lo + _SLICE] for lo in range(0, len(a), _SLICE))


def _turn(a: np.ndarray, by: np.ndarray) -> np.ndarray:
    """A times a small matrix, in single precision."""
    out = np.empty((len(a), by.shape[1]), np.float32)
    for lo in range(0, len(a), _SLICE):
        out[lo:lo + _SLICE] = a[lo:lo + _SLICE] @ by
    return out


def orthonormal(a: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span those of ``a``, by two turns with its Gram matrix; directions it lacks become zeros."""
    for _ in range(2):
        value, vector = np.linalg.eigh(_product(a, a))
        some = value > max(value[-1], 0.0) * 1e-10
        a = _turn(a, np.where(some, vector / np.sqrt(np.where(some, value, 1.0)), 0.0))
    return a


def _sum_slices(partials: DataFrame, width: int) -> list:
    """Add up ``sum`` (single-precision rows of ``width`` columns) by ``at``; a task holds one sum and one addend."""

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for pdf in frames:
            for blob in pdf["sum"]:
                total = total + np.frombuffer(blob, np.float32).astype(float)
        yield pd.DataFrame({"at": [key[0]], "sum": [total.astype(np.float32).tobytes()]})

    with shuffles_end_with_jobs(partials.sparkSession):
        return [(r["at"], np.frombuffer(r["sum"], np.float32).reshape(-1, width)) for r in partials.groupBy("at").applyInPandas(add, "at long, sum binary").collect()]


def randomised_svd(rows: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 3) -> np.ndarray:
    """Leading right singular vectors (FEATURES x rank) of the TF-IDF matrix of all passages of ``rows`` (features, scale, weight).

    Each pass sends the current basis to the tasks, which return A'(A Q) of their rows, in the last pass (A Q)'(A Q). The sums have FEATURES x
    (rank + OVERSAMPLE) entries whatever the number of rows; they are added up in slices, which reach the driver.
    """
    spark = rows.sparkSession
    width = rank + OVERSAMPLE
    basis = np.random.default_rng(seed).standard_normal((FEATURES, width)).astype(np.float32)
    for last in [*[False] * POWER_PASSES, True]:
        basis = orthonormal(basis)
        shared = spark.sparkContext.broadcast(basis * idf[:, None])

        def part(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            q, total = shared.value, np.zeros((width if last else FEATURES, width), np.float32)
            for batch, f, n in _feature_steps(batches):
                blocks = Blocks(n)
                lead, two, sums = blocks.lead, blocks.two, block_sums(q, f, blocks.start)
                y = sums[lead]
                y[two] += sums[lead[two] + 1]
                scale = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f4") * np.asarray(batch.column(2), np.float32)[blocks.doc[lead]]
                y *= scale[:, None]
                if last:
                    total += y.T @ y
                    continue
                y *= scale[:, None]
                sums[:] = 0
                sums[lead] += y
                sums[lead[two] + 1] += y[two]
                _add_rows(total, f, np.repeat(np.arange(len(sums)), blocks.stop - blocks.start), sums)
            if not last:
                total *= idf[:, None]
            for lo in range(0, len(total), _SLICE):
                yield pa.RecordBatch.from_pydict({"at": [lo], "sum": pa.array([total[lo:lo + _SLICE].tobytes()], pa.binary())})

        sums = np.zeros((width if last else FEATURES, width), np.float32)
        for at, values in _sum_slices(rows.select("features", "scale", "weight").mapInArrow(part, "at long, sum binary"), width):
            sums[at:at + _SLICE] = values
        shared.unpersist()
        if last:  # Q'A'AQ: its leading eigenvectors turn the basis into singular vectors
            value, vector = np.linalg.eigh(sums.astype(float))
            return _turn(basis, vector[:, np.argsort(-value)[:rank]])
        basis = sums
    raise AssertionError("unreachable")


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with one big integer as the row of the table."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class Item:
    """A benchmark item: its word hashes, their idf weights and the answer's word hashes."""

    def __init__(self, item_id, h: np.ndarray, answer: np.ndarray, idf: np.ndarray):
        self.id, self.words, self.answer = item_id, h.tolist(), answer.tolist()
        kinds = dict(zip(self.words, idf[feature(h)].tolist(), strict=True))
        self.weights, self.total = kinds, sum(kinds.values())
        # with less weight on rare words near by, the idf share cannot be reached
        self.need = sum(w for w in kinds.values() if w >= RARE) - (1 - IDF_SHARE) * self.total - 1e-3

    def keys(self) -> tuple[list[int], float]:
        """The rarest words, up to KEY_SHARE of the weight, and the weight of them that a region must hold at least."""
        words, held = [], 0.0
        for x, w in sorted(self.weights.items(), key=lambda e: (-e[1], e[0])):
            words.append(x)
            held += w
            if held >= KEY_SHARE * self.total:
                break
        return words, held - (1 - IDF_SHARE) * self.total - 1e-3

    def check(self, region: list[int], after: list[int]) -> tuple[float, float] | None:
        """(LCS share, idf share) if the region holds the item."""
        n = len(self.words)
        have = set(region)
        share = sum(w for x, w in self.weights.items() if x in have) / max(self.total, 1e-12)
        if share < IDF_SHARE:
            return None
        if n < SHORT:
            if not _in_row(self.words, region):
                return None
            ratio = 1.0
        else:
            ratio = lcs(self.words, region) / n
            if ratio < LCS_SHARE:
                return None
        if self.answer and not _in_row(self.answer, after):
            return None
        return ratio, share


class Keys:
    """Postings of the items' keys: which items have a word, with which weight."""

    def __init__(self, items: list[Item]):
        keys = [item.keys() for item in items]
        word = np.array([x for words, _ in keys for x in words], np.uint64)
        order = np.argsort(word, kind="stable")
        self.words, self.begin, self.count = np.unique(word[order], return_index=True, return_counts=True)
        self.item = np.repeat(np.arange(len(items)), [len(words) for words, _ in keys])[order]
        self.weight = np.array([items[i].weights[x] for i, (words, _) in enumerate(keys) for x in words])[order]
        self.need = np.array([n for _, n in keys])
        self.reach = np.maximum([len(item.words) - HALF for item in items], HALF // 2)

    def candidates(self, h: np.ndarray, first: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, begin, stop): passages, given by their first blocks, whose regions hold enough of an item's keys."""
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        pos = np.flatnonzero(self.words[at] == h)
        at = at[pos]
        n = self.count[at]
        ends = np.cumsum(n)
        post = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(self.begin[at], n)
        pos, item = np.repeat(pos, n), self.item[post]
        order = np.argsort(item, kind="stable")
        pos, item, weight = pos[order], item[order], self.weight[post[order]]
        place = item * (len(h) + 1) + pos
        held = np.concatenate([[0.0], np.cumsum(weight)])
        # a key stands in two passages: that of its block and that of the block before
        row = np.searchsorted(start, pos, "right") - 1
        back = np.flatnonzero((row > 0) & (doc[np.maximum(row - 1, 0)] == doc[row]))
        pair = np.unique(np.concatenate([item * len(start) + row, item[back] * len(start) + row[back] - 1]))
        item, row = pair // len(start), pair % len(start)
        begin, stop = np.maximum(first[doc[row]], start[row] - self.reach[item]), np.minimum(first[doc[row] + 1], start[row] + 2 * HALF + self.reach[item])
        low, high = (np.searchsorted(place, item * (len(h) + 1) + x) for x in (begin, stop))
        keep = held[high] - held[low] >= self.need[item]
        return row[keep], item[keep], begin[keep], stop[keep]


def _in_row(needle: list[int], hay: list[int]) -> bool:
    n = len(needle)
    return any(hay[i:i + n] == needle for i in range(len(hay) - n + 1))


def _hashes(texts: list[str | None]) -> list[np.ndarray]:
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    out: list[np.ndarray] = []
    for _, data, offsets in text_steps([batch], lower=True):
        h, first = word_hashes(data, offsets)
        out += [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
          answer_col: str | None = None) -> DataFrame:
    """(id, item, words, lcs_share, idf_share, cosine, at_word): the best match of each document with each item it holds."""
    spark = docs.sparkSession
    id_type = "binary" if dict(docs.dtypes)[id_col] == "binary" else "long"
    rows = docs.select(F.col(f"`{id_col}`").cast(id_type).alias("id"), F.col(f"`{text_col}`").alias("text"))
    bench = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text_col}`").alias("text"),
                             (F.col(f"`{answer_col}`") if answer_col else F.lit(None)).cast("string").alias("answer"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    words_of, words_path = materialize(word_features(rows), "words")
    freq, n = document_frequency(words_of)
    idf = np.log((n + 2) / (freq + 1)).astype(np.float32)

    with shuffles_end_with_jobs(spark):
        fit, fit_path = materialize(fit_rows(words_of, idf), "fit")
    many = fit.agg(F.sum("passages")).first()[0] or 0
    # the sum of the squared weights is FIT_DOCS at most
    fit = fit.withColumn("weight", F.lit(min(1.0, float(np.sqrt(FIT_DOCS / max(many, 1))))))
    release(spark, words_path)  # with plans and shuffles of earlier steps, before the driver holds bases
    found = None
    for number in range(parts):
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == number).orderBy("item", "text").collect()
        words, answers = _hashes([r["text"] for r in part]), _hashes([r["answer"] for r in part])
        items = [Item(r["item"], h, a, idf) for r, h, a in zip(part, words, answers, strict=True) if len(h)]
        words = [h for h in words if len(h)]
        if not items:
            continue
        owner, vectors = [], []
        for i, h in enumerate(words):
            for s in passages(len(h)).tolist():
                owner.append(i)
                vectors.append(feature(h[s:s + 2 * HALF]))
        own_words = [feature(h).astype("<u2") for h in words]
        scales, passage_counts = _scale_columns(Blocks(np.array([len(h) for h in words])), np.concatenate(own_words), idf)
        own = spark.createDataFrame([(f.tobytes(), c, k, 4.0) for f, c, k in zip(own_words, scales.to_pylist(), passage_counts.to_pylist(), strict=True)], fit.schema)
        space = randomised_svd(fit.unionByName(own.coalesce(1)), idf)
        space *= idf[:, None]
        latent = np.stack([space[v].sum(0) for v in vectors])
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        vocabulary = np.zeros(1 << 22, bool)  # hashed: a foreign word in it only lets a candidate through
        vocabulary[(np.concatenate(words) >> U(42)).astype(np.int64)] = True
        owner = np.asarray(owner)
        reach = np.maximum([len(items[i].words) - HALF for i in owner], HALF // 2)
        need = np.asarray([items[i].need for i in owner])
        shared = spark.sparkContext.broadcast((space, latent.T.astype(np.float32), owner, items, vocabulary, reach, need, Keys(items)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            space, latent, owner, items, vocabulary, reach, need, keys = shared.value
            passage_of = np.searchsorted(owner, np.arange(len(items) + 1))
            square = idf * idf
            for batch, data, offsets in _cut(text_steps(batches, "text", _STEP, lower=True)):
                h, first = word_hashes(data, offsets)
                n = np.diff(first)
                # sums over blocks of HALF words; a passage is two of them
                blocks = -(-n // HALF)
                base = np.concatenate([[0], np.cumsum(blocks)])
                if not base[-1]:
                    continue
                doc = np.repeat(np.arange(len(n)), blocks)
                start = first[doc] + (np.arange(base[-1]) - base[doc]) * HALF
                f = feature(h)
                sums = block_sums(space, f, start)
                norm = np.add.reduceat(square[f], start)
                both, size = sums.copy(), norm.copy()
                more = np.flatnonzero(doc[1:] == doc[:-1])
                both[more] += sums[more + 1]
                size[more] += norm[more + 1]
                both /= np.sqrt(np.maximum(size, 1e-12))[:, None]
                score = both @ latent
                weight = np.where(vocabulary[(h >> U(42)).astype(np.int64)] & (idf[f] >= RARE), idf[f], 0)
                rare = np.concatenate([[0.0], np.cumsum(weight, dtype=np.float64)])
                row, col = np.nonzero(score >= COSINE)
                begin, stop = np.maximum(first[doc[row]], start[row] - reach[col]), np.minimum(first[doc[row] + 1], start[row] + 2 * HALF + reach[col])
                keep = np.flatnonzero(rare[stop] - rare[begin] >= need[col])
                row, col, begin, stop = row[keep], owner[col[keep]], begin[keep], stop[keep]
                row, col, begin, stop = (np.concatenate(x) for x in zip((row, col, begin, stop), keys.candidates(h, first, doc, start), strict=True))
                _, keep = np.unique(row * len(items) + col, return_index=True)  # found both ways or by several passages of an item
                best: dict[tuple[int, int], tuple] = {}
                for i, j, a, b in zip(row[keep].tolist(), col[keep].tolist(), begin[keep].tolist(), stop[keep].tolist(), strict=True):
                    d, item = int(doc[i]), items[j]
                    got = item.check(h[a:b].tolist(), h[a:min(int(first[d + 1]), b + 2 * HALF)].tolist() if item.answer else [])
                    if got and (best.get((d, j)) or (0,))[0] < got[0]:
                        best[d, j] = (*got, float(score[i, passage_of[j]:passage_of[j + 1]].max()), int(start[i]) - int(first[d]))
                if best:
                    at, what = zip(*best, strict=True)
                    vals = list(zip(*best.values(), strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)), pa.array([items[i].id for i in what], pa.int64()), pa.array([len(items[i].words) for i in what], pa.int64()),
                         *[pa.array(v, pa.float64()) for v in vals[:3]], pa.array(vals[3], pa.int64())], names=["id", "item", "words", "lcs_share", "idf_share", "cosine", "at_word"])

        hits = rows.mapInArrow(search, f"id {id_type}, item long, words long, lcs_share double, idf_share double, cosine double, at_word long")
        found = hits if found is None else found.unionByName(hits)
    release(spark, fit_path)
    if found is None:
        found = spark.createDataFrame([], f"id {id_type}, item long, words long, lcs_share double, idf_share double, cosine double, at_word long")
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    bench = plain(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")
    return leaks(docs, bench)
