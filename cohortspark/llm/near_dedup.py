"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

Words are runs of ASCII letters, digits and bytes above 127 of the lower-cased text; shingles are five words. A shingle weighs tf x idf (idf
on a scale from 1 to 2), where document frequencies are counted over all documents in FREQ_SLOTS hashed slots (a table of fixed size, broadcast). SAMPLES
consistent weighted samples per document are cut into bands of ROWS; documents that share a band are candidates, and a
candidate pair is linked if its weighted Jaccard similarity, or that of its plain shingle sets, is at least ``threshold``. Classes are the connected components.

Equal texts are one node from the start. Every member of a band's group is compared with the group's least node. Then the
members are grouped anew by NARROW bands of NARROW_ROWS samples; where a member and the group's head (another one in each group) are still in
different components and their samples agree often enough for a similarity of ``threshold``, the two are compared as well. These rounds
settle most groups with few comparisons. Last, in every band group that still holds several components, members are compared with all of
other components, in blocks against blocks (those of the group's largest component only meet the others' blocks): a pair is verified unless its samples agree too seldom or links found before already join its components. So every
pair that shares a band is either in one class or known not to be linked (or under AGREE), whatever the shape of the group.

Edge cases: null texts count as empty; equal texts (empty ones too) are copies; a text of one to four words has one shingle of all its
words; a text without words has no shingle and only its equals are near it. Of equal ids the class takes the least id; null ids sort last.
Rows that repeat the kept document (equal id and equal text) are all marked kept, since nothing tells them apart; equal ids with other texts are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import U, materialize, mix, pack_counts, plain, release, shingles, sorted_groups, sum_counts, text_steps, unpack_counts, word_hashes
from cohortspark.llm.components import components

THRESHOLD, WORDS, BANDS, ROWS = 0.8, 5, 10, 4
SAMPLES = BANDS * ROWS
FREQ_SLOTS = 1 << 20
NARROW, NARROW_ROWS = 24, 8
#: Samples that two documents must share before they are compared after the first round: with a similarity of
#: 0.8, fewer than 16 of 40 agree less than once in 10 million pairs.
AGREE = 16
#: Members of a band group in a block; all pairs of blocks are compared.
BLOCK_ROWS = 512
_STEP = 1 << 19
_POOL: dict[str, np.ndarray] = {}


def _pool() -> dict[str, np.ndarray]:
    """Random draws that samples take by hash: r and c from Gamma(2, 1), beta from (0, 1)."""
    if not _POOL:
        rng, n = np.random.default_rng(20), 1 << 16
        r, c, beta = rng.gamma(2, 1, n), rng.gamma(2, 1, n), rng.random(n)
        _POOL.update(inv=(1 / r).astype(np.float32), r=r.astype(np.float32), beta=beta.astype(np.float32), head=(np.log(c) - r + r * beta).astype(np.float32),
                     mult=rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * U(2) + U(1))
    return _POOL


def _narrow() -> list[list[int]]:
    """Which samples make up each narrow band."""
    rng = np.random.default_rng(8)
    return [sorted(rng.choice(SAMPLES, NARROW_ROWS, replace=False).tolist()) for _ in range(NARROW)]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, tf, begin): distinct shingles of each document in ascending order (48-bit hashes), and each document's first."""
    h, first = word_hashes(data, offsets)
    sh, begin = shingles(h, first, WORDS)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(begin))
    key = np.sort((doc << U(48)) | (sh >> U(16)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(key)))
    key = key[at]
    return key & U((1 << 48) - 1), tf, np.searchsorted(key, np.arange(len(offsets), dtype=np.uint64) << U(48))


def slots(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> U(28)).astype(np.int64)



def document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold a shingle of each slot, number of documents), counted over all rows of ``texts`` (text)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total = np.zeros(FREQ_SLOTS + 1, np.int64)
        for _, data, offsets in _cut(text_steps(batches, "text", _STEP, lower=True)):
            total[:-1] += np.bincount(slots(features(data, offsets)[0]), minlength=FREQ_SLOTS)
            total[-1] += len(offsets) - 1
        yield pa.RecordBatch.from_pydict({"salt": [TaskContext.get().partitionId()], "counts": [pack_counts(total)]})

    rows = sum_counts(texts.select("text").mapInArrow(part, "salt long, counts binary"), [], FREQ_SLOTS + 1).collect()
    total = sum((unpack_counts(r["counts"], np.int64) for r in rows), np.zeros(FREQ_SLOTS + 1, np.int64))
    return total[:-1], int(total[-1])


def _cut(steps):
    """At most 60,000 documents a step: the document number takes 16 bits of a sort key."""
    for batch, data, offsets in steps:
        for lo in range(0, len(offsets) - 1, 60_000):
            o = offsets[lo:lo + 60_001]
            yield batch.slice(lo, len(o) - 1), data[o[0]:o[-1]], o - o[0]


def sample(shingle: np.ndarray, weight: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(documents, SAMPLES) consistent weighted samples; documents without shingles get zeros."""
    pool = _pool()
    n = len(begin) - 1
    out = np.zeros((n, SAMPLES), np.uint64)
    full = np.flatnonzero(np.diff(begin))
    if not len(full):
        return out
    starts = begin[full]
    size = np.diff(np.append(starts, len(shingle)))
    lw = np.log(weight).astype(np.float32)
    for k in range(SAMPLES):
        at = ((shingle * pool["mult"][k]) >> U(48)).astype(np.int64)
        t = np.floor(lw * pool["inv"][at] + pool["beta"][at])
        a = pool["head"][at] - pool["r"][at] * t
        least = np.minimum.reduceat(a, starts)
        hit = np.flatnonzero(a == np.repeat(least, size))
        doc = np.searchsorted(starts, hit, "right") - 1
        first = np.ones(len(hit), bool)
        first[1:] = doc[1:] != doc[:-1]
        hit = hit[first]
        out[full, k] = mix(shingle[hit] ^ (t[hit].astype(np.int64).view(np.uint64) << U(48)), k)
    return out


def _weights(shingle: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return tf * idf[slots(shingle)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two (ascending shingles, weights) lists."""
    at = np.minimum(np.searchsorted(b[0], a[0]), max(len(b[0]) - 1, 0))
    if not len(a[0]) or not len(b[0]):
        return 0.0
    both = b[0][at] == a[0]
    low = float(np.minimum(a[1][both], b[1][at[both]]).sum())
    return low / (float(a[1].sum()) + float(b[1].sum()) - low)


def plain_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all distinct shingles."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def _verified(pairs: DataFrame, feats: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (fa, wa, fb, wb) in enumerate(zip(*(batch.column(c) for c in range(2, 6)), strict=True)):
                a = np.frombuffer(fa.as_buffer(), np.uint64), np.frombuffer(wa.as_buffer(), np.float32)
                b = np.frombuffer(fb.as_buffer(), np.uint64), np.frombuffer(wb.as_buffer(), np.float32)
                if weighted_jaccard(a, b) >= threshold or plain_jaccard(a[0], b[0]) >= threshold:
                    keep.append(i)
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["u", "v"])

    one = feats.select(F.col("key").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb"))
    two = feats.select(F.col("key").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "sa", "wa", "sb", "wb").mapInArrow(check, "u binary, v binary")


def _candidates(x: np.ndarray, root: np.ndarray, side: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows in different components whose samples agree often enough, most alike first, and that share no band before ``band``.

    ``side`` 0 and 1: pairs across; all 2: pairs within.
    """
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    agree = np.zeros((len(left), len(right)), np.uint8)
    for k in range(SAMPLES):
        agree += x[left, k][:, None] == x[right, k][None, :]
    i, j = np.nonzero((agree >= AGREE) & (root[left][:, None] != root[right][None, :]))
    agree, i, j = agree[i, j], left[i], right[j]
    keep = (side[i] != 2) | (i < j)
    for t in range(band):
        keep &= (x[i, t * ROWS:(t + 1) * ROWS] != x[j, t * ROWS:(t + 1) * ROWS]).any(1)
    order = np.argsort(agree[keep], kind="stable")[::-1]
    return i[keep][order], j[keep][order]


_BLOCK = ["at", "lo", "hi"]


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, pairs' first rows, pairs' second rows) of each pair of blocks that holds candidates."""
    for table in sorted_groups(batches, _BLOCK, rows):
        cols = [np.asarray(table.column(c)) for c in _BLOCK]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        ends = np.append(np.flatnonzero(new), table.num_rows)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            part = table.slice(a, b - a)
            x = np.asarray(part.column("samples").combine_chunks().flatten()).reshape(-1, SAMPLES)
            root = np.asarray(part.column("root").combine_chunks().dictionary_encode().indices)
            i, j = _candidates(x, root, np.asarray(part.column("side")), part.column("band")[0].as_py())
            if len(i):
                yield part, i, j


def _settle(state: DataFrame, members: DataFrame, feats: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) between components, from all pairs of members of each band group that holds several. ``state`` has (key, samples, root).

    Blocks first travel with samples only; shingles follow to the members that have a candidate there. A task joins the components of
    the links it finds, so it verifies no pair whose link would change nothing, and emits a forest.
    """
    group = members.select("at", "band", "key").join(state.select("key", "root"), "key")
    sizes = group.groupBy("at", "root").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("at").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    # members of the group's largest component need no comparison among themselves: their blocks only meet those of the others
    one = F.col("n") <= BLOCK_ROWS
    open_ = open_.select("at", F.when(~one, F.col("top.root")).alias("main"), F.when(one, 1).otherwise(F.ceil((F.col("n") - F.col("top.n")) / BLOCK_ROWS)).cast("long").alias("small"),
                         F.when(one, 0).otherwise(F.ceil(F.col("top.n") / BLOCK_ROWS)).cast("long").alias("large"))
    in_main = F.coalesce(F.col("root") == F.col("main"), F.lit(False))
    group = (group.join(open_, "at")
             .withColumn("own", F.when(in_main, F.col("small") + F.pmod(F.xxhash64("key"), F.greatest("large", F.lit(1)))).otherwise(F.pmod(F.xxhash64("key"), F.col("small"))))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(in_main, F.col("small")).otherwise(F.col("small") + F.col("large")) - 1))))
    group = group.select("at", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "band",
                         F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "key", "root")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_BLOCK, "band", "side", "key", "root"]
        for part, i, j in _blocks(batches, 4096):
            yield from part.select(names).take(pa.array(np.unique(np.concatenate([i, j])))).combine_chunks().to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, i, j in _blocks(batches, 256):
            key, root = part.column("key").to_pylist(), part.column("root").to_pylist()
            sh = [np.frombuffer(v.as_buffer(), np.uint64) for v in part.column("shingles")]
            wt = [np.frombuffer(v.as_buffer(), np.float32) for v in part.column("weights")]
            up = {r: r for r in root}
            u, v = [], []
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                a, b = root[p], root[q]
                while up[a] != a:
                    up[a] = a = up[up[a]]
                while up[b] != b:
                    up[b] = b = up[up[b]]
                if a != b and (weighted_jaccard((sh[p], wt[p]), (sh[q], wt[q])) >= threshold or plain_jaccard(sh[p], sh[q]) >= threshold):
                    up[a] = b
                    u.append(key[p])
                    v.append(key[q])
            if u:
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})

    parts = max(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    own = state.select("key", "samples")
    schema = "at long, lo long, hi long, band int, side int, key binary, root binary"
    wanted, path = materialize(group.join(own, "key").repartition(parts, *_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(ask, schema), "blocks")
    links, _ = materialize(wanted.join(own, "key").join(feats, "key").repartition(parts, *_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(verify, "u binary, v binary"), "verified")
    release(state.sparkSession, path)
    return links


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, key, class_id, class_size, kept) of every row: ``key`` names its text, class_id is the least id of its class.

    ``kept`` marks the rows with the class's least id and, among those, its least text key.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))
    freq, n = document_frequency(src)
    # idf on a scale from 1 (in every document) to 2 (in none): a large group of copies makes its own shingles
    # frequent, and on the raw scale its few edits would outweigh all that its members share
    idf = (1 + np.log((n + 2) / (freq + 1)) / np.log(n + 2)).astype(np.float32)
    idf = spark.sparkContext.broadcast(idf)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in _cut(text_steps(batches, "text", _STEP, lower=True)):
            shingle, tf, begin = features(data, offsets)
            samples = sample(shingle, _weights(shingle, tf, idf.value), begin)
            some = np.diff(begin) > 0
            m = len(samples)
            vals = pa.array(samples.reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * SAMPLES), vals)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists, pa.array(some)], names=["id", "key", "samples", "some"])

    signed, signed_path = materialize(src.mapInArrow(sign, "id long, key binary, samples array<long>, some boolean"), "signed")
    nodes, nodes_path = materialize(signed.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("samples").alias("samples"), F.first("some").alias("some")), "nodes")
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice("samples", b * ROWS + 1, ROWS))))
    groups = nodes.where("some").select("key", band.alias("band", "at"))
    heads = groups.groupBy("at").agg(F.min("key").alias("head"), F.count("*").alias("n")).where("n > 1")
    members, members_path = materialize(groups.join(heads, "at").select("at", "band", "key", "head"), "members")

    known = members.where("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b")).distinct()
    known, known_path = materialize(known, "pairs")
    asked = members.select("key").distinct()

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch, data, offsets in _cut(text_steps(batches, "text", _STEP, lower=True)):
            shingle, tf, begin = features(data, offsets)
            weight = _weights(shingle, tf, idf.value).astype(np.float32)
            keys = batch.column(0).to_pylist()
            new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
            yield pa.RecordBatch.from_pydict({"key": pa.array([keys[i] for i in new], pa.binary()),
                                              "shingles": pa.array([shingle[begin[i]:begin[i + 1]].tobytes() for i in new], pa.binary()),
                                              "weights": pa.array([weight[begin[i]:begin[i + 1]].tobytes() for i in new], pa.binary())})

    feats, feats_path = materialize(src.select("key", "text").join(asked, "key").mapInArrow(featurise, "key binary, shingles binary, weights binary").dropDuplicates(["key"]), "features")
    links, links_path = materialize(_verified(known, feats, threshold), "verified")
    roots, roots_path = materialize(components(links), "roots")

    # second round: narrower groups, each with a head of its own, for members that differ from their head's component
    state = asked.join(nodes.select("key", "samples"), "key").join(roots.withColumnRenamed("node", "key"), "key", "left")
    narrow = F.array(*[F.xxhash64(F.lit(BANDS + i), *[F.get("samples", int(j)) for j in pick]) for i, pick in enumerate(_narrow())])
    narrow = state.select("key", F.coalesce("root", "key").alias("root"), F.explode(narrow).alias("at"))
    heads = (narrow.groupBy("at").agg(F.min(F.struct(F.xxhash64("key", "at").alias("rank"), "key", "root")).alias("head"), F.min("root").alias("low"), F.max("root").alias("high"))
             .where("low <> high").select("at", F.col("head.key").alias("head"), F.col("head.root").alias("head_root")))
    cross = (narrow.join(heads, "at").where("root <> head_root").select(F.greatest("key", "head").alias("a"), F.least("key", "head").alias("b")).distinct()
             .join(known, ["a", "b"], "left_anti"))
    own = nodes.select("key", "samples")
    cross = (cross.join(own.toDF("a", "xs"), "a").join(own.toDF("b", "ys"), "b")
             .where(F.size(F.filter(F.zip_with("xs", "ys", lambda x, y: x == y), lambda e: e)) >= AGREE).select("a", "b"))
    cross, cross_path = materialize(cross, "pairs")
    more, more_path = materialize(_verified(cross, feats, threshold), "verified")
    if not more.isEmpty():
        links = links.union(more)
        roots, roots_path = materialize(components(links), "roots")

    # last: all pairs of the members that still differ
    state = asked.join(own, "key").join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "samples", F.coalesce("root", "key").alias("root"))
    rest = _settle(state, members, feats, threshold)
    if not rest.isEmpty():
        roots, _ = materialize(components(links.union(rest)), "roots")
    release(spark, feats_path, members_path, known_path, cross_path, more_path, links_path)

    classed = nodes.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "least", "copies", F.coalesce("root", "key").alias("root"))
    rep = classed.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "key")).alias("rep"), F.sum("copies").alias("class_size"))
    table = classed.join(rep, "root").select("key", F.col("rep.least").alias("class_id"), F.col("rep.key").alias("rep_key"), "class_size")
    out = signed.select("id", "key").join(table, "key")
    kept = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("rep_key"))
    return out.select(F.col("id").alias(id_col), "key", "class_id", "class_size", kept.alias("kept"))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")).select("doc_id", "class_id", "class_size", "kept")
