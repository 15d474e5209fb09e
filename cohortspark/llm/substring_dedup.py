"""Repeated byte strings across documents, by minimiser sampling and grouping by hash, in place of external induced sorting of suffixes.

A suffix array of every byte would carry some 20 bytes per byte of text through each sort (about 34 times the input against a disk budget of
4 times). Whether a ``length``-byte string also starts elsewhere needs no suffix order, so none is made: there are no common-prefix
values, no priority queue of suffix tuples and no recursive induction. Instead:

1. Reduced alphabet: the ``name_bytes`` bytes at each position are named by a 64-bit hash.
2. Sampled suffixes: a position is sampled if its name is the least in some window (the leftmost of equals). Each
   ``length``-byte string holds exactly one position that it samples, decided by its own bytes only, so equal strings sample
   equal places, and one sample stands for a whole run of string starts.
3. Grouping: the samples are grouped by name and context (64-bit hashes, so in no lexical order) by Spark, which spills what
   memory does not hold.
4. Comparison: samples with one common context settle all strings they stand for at once. Where one name has several
   contexts, the strings at each distance from the sample are compared through 64-bit hashes of their ``length`` bytes,
   once per distinct context, never per copy.

Spans are merged within a document. Results depend on a text and on the whole table only.

Edge cases: null texts are empty; texts shorter than ``length`` bytes lose nothing. Repeated rows are occurrences of their
own, so equal texts of ``length`` bytes or more are removed whole. Rows that share a document id keep a result each. Extra columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import U, materialize, plain, prefix_hash, release, sorted_groups, span_hash, text_steps

LENGTH, NAME_BYTES = 200, 64
#: Distinct contexts of one name that a task compares; names with more are compared through a shuffle by string hash.
TASK_CONTEXTS = 4096


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values (len(x) - w + 1 entries), by block-wise prefix and suffix minima."""
    n = len(x)
    pad = -(-n // w) * w
    y = np.full(pad, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    y = y.reshape(-1, w)
    head = np.minimum.accumulate(y, 1).reshape(-1)
    tail = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(tail[:n - w + 1], head[w - 1:n])


def sample(data: np.ndarray, offsets: np.ndarray, length: int, name_bytes: int) -> tuple[np.ndarray, ...]:
    """(document, position, first start, last start, name, context) of the sampled positions.

    Positions and starts are byte offsets in the document; the sample stands for the strings that start from the first to the last of them.
    """
    e = np.zeros(0, np.int64)
    if len(data) < length:
        return e, e, e, e, e.astype(np.uint64), e.astype(np.uint64)
    s = prefix_hash(data)
    at = np.arange(len(data) - name_bytes + 1)
    name = span_hash(s, at, at + name_bytes)
    low = _window_min((name & U(0xFFFFFFFF00000000)) | at.astype(np.uint64), length - name_bytes + 1)
    pos = (low & U(0xFFFFFFFF)).astype(np.int64)  # sampled position of the string that starts here
    doc_end = np.repeat(offsets[1:], np.diff(offsets))[:len(pos)]
    start = np.flatnonzero(np.arange(len(pos)) + length <= doc_end)
    p = pos[start]
    new = np.ones(len(start), bool)
    new[1:] = (p[1:] != p[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, p = start[first], start[last] if len(start) else e, p[first]
    doc = np.searchsorted(offsets, lo, "right") - 1
    # where the sample stands inside its context is part of the context
    context = span_hash(s, lo, hi + length, 1) ^ ((p - lo).astype(np.uint64) * U(0x9E3779B97F4A7C15))
    base = offsets[doc]
    return doc, p - base, lo - base, hi - base, name[p], context


def _covered(row_name: np.ndarray, data: list[bytes], left: np.ndarray, reach: np.ndarray, copies: np.ndarray, length: int) -> list[list[int]]:
    """For each context: [from, to) byte pairs, relative to its first byte, of the strings that stand in another one too.

    ``left`` bytes stand before the sample, ``reach`` is the number of string starts.
    """
    sizes = np.asarray([len(d) for d in data])
    base = np.concatenate([[0], np.cumsum(sizes)])
    s = prefix_hash(np.frombuffer(b"".join(data), np.uint8))
    row = np.repeat(np.arange(len(data)), reach)
    k = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(reach)[:-1]]), reach)
    start = base[row] + k
    key = span_hash(s, start, start + length, 2)
    key ^= (k - left[row] + length).astype(np.uint64) * U(0xD6E8FEB86659FD93) ^ row_name[row].view(np.uint64)
    _, inverse = np.unique(key, return_inverse=True)
    found = (np.bincount(inverse, copies[row]) >= 2)[inverse]
    out: list[list[int]] = [[] for _ in data]
    hit = np.flatnonzero(found)
    if len(hit):
        cut = np.flatnonzero((np.diff(hit) != 1) | (row[hit[1:]] != row[hit[:-1]]))
        for a, b in zip(hit[np.r_[0, cut + 1]], hit[np.r_[cut, len(hit) - 1]], strict=True):
            out[row[a]] += [int(k[a]), int(k[b]) + length]
    return out


def repeated_spans(df: DataFrame, text_col: str = "text", length: int = LENGTH, name_bytes: int = NAME_BYTES) -> tuple[DataFrame, str]:
    """(key, spans) of every distinct text that loses bytes, and the folder it is kept in.

    ``key`` is the text's md5; ``spans`` are [from, to) byte pairs, which may overlap.
    """
    spark = df.sparkSession
    texts = df.select(F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))).alias("key"), F.col(f"`{text_col}`").alias("text"))

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_steps(batches, step=1 << 19):
            doc, p, lo, hi, name, context = sample(data, offsets, length, name_bytes)
            if len(doc):
                yield pa.RecordBatch.from_pydict({"key": batch.column(0).take(pa.array(doc)), "p": pa.array(p), "lo": pa.array(lo), "hi": pa.array(hi),
                                                  "name": pa.array(name.view(np.int64)), "context": pa.array(context.view(np.int64))})

    sampled, sampled_path = materialize(texts.mapInArrow(samples, "key binary, p long, lo long, hi long, name long, context long"), "samples")
    contexts = sampled.groupBy("name", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "p", "lo", "hi")).alias("one"))
    contexts, contexts_path = materialize(contexts, "contexts")
    names = contexts.groupBy("name").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    known, known_path = materialize(contexts.join(names, "name"), "repeated")
    release(spark, contexts_path)

    # bytes around one sample of each context of the names that have several
    wanted = known.where("kinds > 1").select("one.*", "name", "context", "n", "kinds")
    asked = wanted.groupBy("key").agg(F.collect_list(F.struct("p", "lo", "hi", "name", "context", "n", "kinds")).alias("asked"))
    rows = texts.join(asked, "key")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("name", "context", "n", "kinds", "left", "reach", "bytes")}
            for key, text, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key in seen:
                    continue  # another copy of the text
                seen.add(key)
                raw = text.encode()
                for r in some:
                    for k in ("name", "context", "n", "kinds"):
                        out[k].append(r[k])
                    out["left"].append(r["p"] - r["lo"])
                    out["reach"].append(r["hi"] - r["lo"] + 1)
                    out["bytes"].append(raw[r["lo"]:r["hi"] + length])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([*[(k, pa.int64()) for k in list(out)[:-1]], ("bytes", pa.binary())]))

    near = rows.select("key", "text", "asked").mapInArrow(around, "name long, context long, n long, kinds long, left long, reach long, bytes binary")
    near, near_path = materialize(near.dropDuplicates(["name", "context"]), "around")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["name"], 4096):
            spans = _covered(np.asarray(t.column("name")), t.column("bytes").to_pylist(), np.asarray(t.column("left")), np.asarray(t.column("reach")), np.asarray(t.column("n")), length)
            some = [i for i, x in enumerate(spans) if x]
            if some:
                yield pa.RecordBatch.from_pydict({"name": t.column("name").take(some).combine_chunks(), "context": t.column("context").take(some).combine_chunks(),
                                                  "part": pa.array([spans[i] for i in some], pa.list_(pa.int64()))})

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    small = near.where(F.col("kinds") <= TASK_CONTEXTS).repartition(parts, "name").sortWithinPartitions("name").mapInArrow(compare, "name long, context long, part array<long>")
    parted = small.union(_compare_by_shuffle(near.where(F.col("kinds") > TASK_CONTEXTS), length))

    whole = known.where("n > 1").select("name", "context", F.lit(None).cast("array<long>").alias("part"))
    settled = whole.unionByName(parted.join(known.where("n = 1").select("name", "context"), ["name", "context"], "left_semi"))
    hit = sampled.select("key", "lo", "hi", "name", "context").join(settled, ["name", "context"])
    pairs = F.when(F.col("part").isNull(), F.array(F.struct(F.col("lo").alias("a"), (F.col("hi") + length).alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), (F.size("part") / 2 - 1).cast("int")), lambda i: F.struct((F.col("lo") + F.get("part", (2 * i).cast("int"))).alias("a"), (F.col("lo") + F.get("part", (2 * i + 1).cast("int"))).alias("b"))))
    # copies of a text have equal spans: distinct rows first, then one bounded list per text
    hit = hit.select("key", F.explode(pairs).alias("s")).select("key", "s.a", "s.b").distinct()
    spans = hit.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    spans, path = materialize(spans, "spans")
    release(spark, sampled_path, known_path, near_path)
    return spans, path


def _compare_by_shuffle(near: DataFrame, length: int) -> DataFrame:
    """The same comparison for names with very many contexts: one row per string, grouped by its hash."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                b = batch.slice(lo, 1000)
                data, reach, left = b.column(6).to_pylist(), np.asarray(b.column(5)), np.asarray(b.column(4))
                base = np.concatenate([[0], np.cumsum([len(d) for d in data])])
                s = prefix_hash(np.frombuffer(b"".join(data), np.uint8))
                row = np.repeat(np.arange(len(data)), reach)
                k = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(reach)[:-1]]), reach)
                h = span_hash(s, base[row] + k, base[row] + k + length, 2)
                yield pa.RecordBatch.from_pydict({"name": np.asarray(b.column(0))[row], "context": np.asarray(b.column(1))[row], "n": np.asarray(b.column(2))[row],
                                                  "k": k, "d": k - left[row], "h": h.view(np.int64)})

    rows = near.mapInArrow(strings, "name long, context long, n long, k long, d long, h long")
    twice = rows.groupBy("name", "d", "h").agg(F.sum("n").alias("total")).where("total > 1")
    hit = rows.where("n = 1").join(twice, ["name", "d", "h"])
    return hit.groupBy("name", "context").agg(F.flatten(F.collect_list(F.array("k", F.col("k") + length))).alias("part"))


def merge_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of sorted, overlapping or touching spans."""
    out: list[list[int]] = []
    for s in spans or ():
        if out and s["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["b"])
        else:
            out.append([s["a"], s["b"]])
    return [(a, b) for a, b in out]


def remove_repeats(df: DataFrame, text_col: str = "text", length: int = LENGTH, name_bytes: int = NAME_BYTES, whole_characters: bool = False) -> DataFrame:
    """Append kept (binary: the remaining bytes; with ``whole_characters`` those of ``text_without``), n_bytes, n_removed, n_spans and spans (array of from, to) to every row of ``df``.

    Only texts that lose bytes are joined with their spans' rows; the join is by text, so copies get equal results.
    """
    spans, _ = repeated_spans(df, text_col, length, name_bytes)
    own = [f"_c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*own).withColumn("_key", F.unhex(F.md5(F.coalesce(F.col(own[df.columns.index(text_col)]), F.lit("")).cast("binary"))))
    joined = rows.join(spans.select(F.col("key").alias("_key"), F.col("spans").alias("_spans")), "_key", "left").drop("_key")
    schema = ", ".join([*(f"{o} {t}" for o, (_, t) in zip(own, df.dtypes, strict=True)), "kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<a: long, b: long>>"])
    at = df.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                new: dict[str, list] = {k: [] for k in ("kept", "n_bytes", "n_removed", "n_spans", "spans")}
                for text, found in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    runs = merge_spans(found)
                    edge = [0, *[x for r in runs for x in r], len(raw)]
                    kept = b"".join(raw[edge[i]:edge[i + 1]] for i in range(0, len(edge), 2))
                    if whole_characters:
                        kept = text_without(text, found).encode()
                    for k, v in zip(new, (kept, len(raw), sum(y - x for x, y in runs), len(runs), [{"a": x, "b": y} for x, y in runs]), strict=True):
                        new[k].append(v)
                span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(new["kept"], pa.binary()), *[pa.array(new[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")],
                                                  pa.array(new["spans"], span)], names=[*own, *new])

    return joined.mapInArrow(cut, schema).toDF(*df.columns, "kept", "n_bytes", "n_removed", "n_spans", "spans")


def text_without(text: str | None, spans: list[dict] | None) -> str:
    """The text without the whole characters inside ``spans`` (byte offsets); a character that a span cuts is kept."""
    raw = (text or "").encode()
    out, at = [], 0
    for a, b in merge_spans(spans):
        while a < len(raw) and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        out.append(raw[at:a])
        at = max(a, b)
    return (b"".join(out) + raw[at:]).decode()


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, by listing every string; for small tests."""
    raws = [(t or "").encode() for t in texts]
    count: dict[bytes, int] = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            count[r[i:i + length]] = count.get(r[i:i + length], 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if count[r[i:i + length]] > 1:
                gone[i:i + length] = True
        gone = gone[:len(r)]
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
