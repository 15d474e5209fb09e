"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Each table applies ``hashes`` pseudo-random rotations (three rounds of random signs and a fast Hadamard transform) and
takes the signed axis of largest magnitude of each. A vector is put into its own bucket and, per hash, into the bucket
with that hash's second-best axis. Inside a bucket all pairs are compared in double precision, blocks against blocks, so a
hot bucket is split over many tasks; a pair that shares several buckets counts in the first of them only.
A task emits link counts and a spanning forest of the links it found, never the pairs.

Equal vectors are hashed once, and their copies are counted in. The number of hashes per table follows the number
of vectors, so that buckets stay small.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing (n_links 0, a
component of their own). Vectors of different lengths never link. Rows with a null id get null component and kept.
Repeated ids with equal vectors are copies of each other. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import materialize, mix, plain, sorted_groups
from cohortspark.llm.components import components

TABLES, BLOCK_ROWS, BUCKET_ROWS = 8, 2048, 256
_SIGNS: dict[tuple, np.ndarray] = {}


def _signs(dim: int, n: int, seed: int) -> np.ndarray:
    key = (dim, n, seed)
    if key not in _SIGNS:
        _SIGNS[key] = np.random.default_rng([seed, dim]).choice([-1.0, 1.0], size=(n, 3, dim))
    return _SIGNS[key]


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two long)."""
    h, (n, d) = 1, x.shape
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def placements(x: np.ndarray, tables: int, hashes: int, seed: int = 7) -> np.ndarray:
    """(rows, tables, 1 + hashes) bucket numbers: the own bucket, then one probe per hash."""
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    pad = np.zeros((n, d))
    pad[:, :dim] = x
    signs = _signs(d, tables * hashes, seed)
    axis = np.empty((2, n, tables, hashes), np.uint64)
    for t in range(tables):
        for k in range(hashes):
            y = pad
            for r in range(3):
                y = hadamard(y * signs[t * hashes + k, r])
            size = np.abs(y)
            rows = np.arange(n)
            for rank in range(2):
                top = size.argmax(1)
                axis[rank, :, t, k] = 2 * top + (y[rows, top] < 0)
                size[rows, top] = -1
    out = np.empty((n, tables, 1 + hashes), np.uint64)
    for p in range(1 + hashes):
        h = np.zeros((n, tables), np.uint64)
        for k in range(hashes):
            h = mix(h + axis[1 if p == k + 1 else 0, :, :, k], k)
        out[:, :, p] = mix(h, dim)
    return out.view(np.int64)


def _count_links(ids: np.ndarray, weight: np.ndarray, x: np.ndarray, place: np.ndarray, table: int, bucket: int,
                 side: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Link counts of the group's rows and a forest of its links. ``side`` 0 and 1: compare across; all 2: within."""
    n = len(ids)
    links, forest = np.zeros(n, np.int64), []
    root = np.arange(n)
    left = np.flatnonzero(side != 1)
    right = np.flatnonzero(side != 0)
    for lo in range(0, len(left), 512):
        a = left[lo:lo + 512]
        i, j = np.nonzero(x[a] @ x[right].T >= threshold)
        i, j = a[i], right[j]
        if side[0] == 2:
            keep = i < j
            i, j = i[keep], j[keep]
        for part in range(0, len(i), 200_000):
            p, q = i[part:part + 200_000], j[part:part + 200_000]
            first = np.ones(len(p), bool)
            for t in range(table):
                first &= ~(place[p, t, :, None] == place[q, t, None, :]).any((1, 2))
            shared = place[p, table, :, None] == place[q, table, None, :]
            first &= ~(shared & (place[p, table, :, None] < bucket)).any((1, 2))
            p, q = p[first], q[first]
            links += np.bincount(p, weight[q], n).astype(np.int64) + np.bincount(q, weight[p], n).astype(np.int64)
            while len(p):  # hook the roots of linked rows until every link is inside a tree
                rp, rq = root[p], root[q]
                open_ = rp != rq
                p, q, rp, rq = p[open_], q[open_], rp[open_], rq[open_]
                if not len(p):
                    break
                high, low = np.maximum(rp, rq), np.minimum(rp, rq)
                high, at = np.unique(high, return_index=True)
                forest += list(zip(ids[p[at]].tolist(), ids[q[at]].tolist(), strict=True))
                root[high] = low[at]
                while True:
                    up = root[root]
                    if (up == root).all():
                        break
                    root = up
    return links, forest


def link_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, tables: int = TABLES) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``df``."""
    single = dict(df.dtypes)[vec_col] == "array<float>"
    kind = np.dtype("<f4") if single else np.dtype("<f8")
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<float>" if single else "array<double>").alias("vec"))
    ok = (F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
          & F.exists("vec", lambda c: c != 0))
    src = src.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("key", F.when(F.col("ok"), F.md5(F.concat_ws(",", F.col("vec").cast("array<string>")))))
    src, _ = materialize(src, "vectors")
    nodes = src.where("ok and id is not null").groupBy("key").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    n = nodes.count()
    dim = src.where("ok").agg(F.max(F.size("vec"))).first()[0] or 1
    hashes = max(1, math.ceil(math.log(max(2.0, n / BUCKET_ROWS)) / math.log(2 * dim)))

    rep = src.where("ok").join(nodes, "key").where("id = node").dropDuplicates(["node", "key"]).select("node", "copies", "vec")
    width = tables * (1 + hashes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                ids, copies = np.asarray(part.column(0)), np.asarray(part.column(1))
                vecs = [np.asarray(v, kind) for v in part.column(2).to_pylist()]
                for d in sorted({len(v) for v in vecs}):
                    at = [i for i, v in enumerate(vecs) if len(v) == d]
                    pl = placements(unit(np.stack([vecs[i] for i in at])), tables, hashes)
                    offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * width)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(copies[at]), pa.array([vecs[i].tobytes() for i in at], pa.binary()),
                                                      pa.ListArray.from_arrays(offsets, pa.array(pl.reshape(-1)))], names=["id", "copies", "vec", "place"])

    signed, _ = materialize(rep.mapInArrow(place, "id long, copies long, vec binary, place array<long>"), "signed")
    # buckets first travel as numbers only; vectors follow to those that hold several
    placed = signed.select("id", F.posexplode("place").alias("at", "bucket")).select("id", F.floor(F.col("at") / (1 + hashes)).cast("long").alias("tab"), "bucket")
    sizes = placed.groupBy("tab", "bucket").agg(F.count("*").alias("rows")).where("rows > 1").withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("long"))
    hot = placed.join(sizes, ["tab", "bucket"])
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    hot = hot.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    hot = hot.select("tab", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                     F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("long").alias("side"),
                     "id").join(signed, "id")
    keys = ["tab", "bucket", "lo", "hi"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, keys, 4096):
            cols = {c: np.asarray(table.column(c)) for c in (*keys, "side", "id", "copies")}
            vec = table.column("vec").to_pylist()
            pl = np.asarray(table.column("place").combine_chunks().flatten()).reshape(-1, tables, 1 + hashes)
            new = np.ones(table.num_rows, bool)
            new[1:] = np.logical_or.reduce([cols[k][1:] != cols[k][:-1] for k in keys])
            ends = np.append(np.flatnonzero(new), table.num_rows)
            us, vs, ns = [], [], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                side = cols["side"][a:b]
                if b - a < 2 or not ((side == 2).all() or (side == 0).any() and (side == 1).any()):
                    continue
                x = unit(np.stack([np.frombuffer(v, kind) for v in vec[a:b]]))
                ids = cols["id"][a:b]
                links, forest = _count_links(ids, cols["copies"][a:b], x, pl[a:b], int(cols["tab"][a]), int(cols["bucket"][a]), side, threshold)
                some = np.flatnonzero(links)
                us += ids[some].tolist() + [f[0] for f in forest]
                vs += [None] * len(some) + [f[1] for f in forest]
                ns += links[some].tolist() + [0] * len(forest)
            if us:
                yield pa.RecordBatch.from_pydict({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64()), "n": pa.array(ns, pa.int64())})

    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = hot.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(verify, "u long, v long, n long")
    found, _ = materialize(found, "found")
    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("near"))
    roots = components(found.where("v is not null").select("u", "v")).withColumnRenamed("root", "component")
    table = nodes.join(counts, "node", "left").join(roots, "node", "left").select("key", "node", "copies", "near", "component")
    out = src.select("id", "key").join(table, "key", "left")
    component = F.coalesce("component", "node", "id")
    return out.select(
        F.col("id").alias(id_col), F.when(F.col("id").isNull() | F.col("node").isNull(), 0).otherwise(F.coalesce("near", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), component).alias("component_id"), (F.col("id") == component).alias("kept"))


def op5_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return link_vectors(plain(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"))
