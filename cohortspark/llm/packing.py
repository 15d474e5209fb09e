"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

A document is tokenised, ``end_id`` appended, and if longer than ``capacity`` cut into capacity-token pieces of which the
first may be shorter. Full pieces are sequences of their own. The others are dealt by hash into shards of about SHARD_ITEMS
pieces; each shard is evolved on ISLANDS islands, which are separate Spark groups. A genome is a set of bins. Crossover injects
whole well-filled bins of one parent into the other, removes the bins that held the same pieces, and puts the displaced pieces
back best-fit decreasing. After each epoch every island sends its elite to the next one. The best island's packing is the result.

The number of shards follows the number of pieces, so a group is bounded at any scale; a shard wastes at most one partly filled bin over the whole.

Edge cases: null texts are empty (one token, the end id). Repeated rows are packed as often as they stand there. An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import materialize, plain
from cohortspark.llm.tokens import default_path, encoder

CAPACITY, SHARD_ITEMS, ISLANDS, POPULATION, GENERATIONS, EPOCHS = 1024, 8192, 3, 4, 4, 2
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece of each document."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                step = batch.slice(lo, 256)
                out: list[tuple] = []
                for doc, blob in zip(step.column(0).to_pylist(), enc.encode(step.column(1).to_pylist()), strict=True):
                    ids = np.append(np.frombuffer(blob, enc.dtype), [end_id]).astype("<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    out += [(doc, i, a, b - a, zlib.crc32(ids[a:b].data)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(part, PIECE)


# ---------------------------------------------------------------- the genetic algorithm on one island

def best_fit(order: np.ndarray, sizes: list[int], bins: np.ndarray, fill: list[int], capacity: int) -> None:
    """Put the pieces of ``order`` into the fullest bins that still hold them, opening bins as needed.

    ``bins`` (bin of each piece) and ``fill`` (tokens in each bin) are changed in place.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r is set when some bin has r tokens of room
    for b, f in enumerate(fill):
        if 0 < f < capacity:
            rooms[capacity - f].append(b)
            open_ |= 1 << (capacity - f)
    free = [b for b, f in enumerate(fill) if f == 0]
    for i in order.tolist():
        s = sizes[i]
        fits = open_ >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = rooms[r].pop()
            if not rooms[r]:
                open_ ^= 1 << r
        else:
            r = capacity
            if free:
                b = free.pop()
            else:
                b = len(fill)
                fill.append(0)
        bins[i] = b
        fill[b] += s
        if r > s:
            rooms[r - s].append(b)
            open_ |= 1 << (r - s)


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """(number of bins, minus the mean squared fill): less is better."""
    fill = np.bincount(bins, sizes)
    fill = fill[fill > 0]
    return len(fill), -float(np.square(fill / capacity).mean()) if len(fill) else 0.0


def compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def crossover(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject well-filled bins of ``second`` into ``first``, drop first's bins that share pieces with them, best-fit the displaced."""
    fill = np.bincount(second, sizes)
    good = fill >= capacity - rng.integers(0, 4)
    pick = good & (rng.random(len(fill)) < 0.5)
    injected = pick[second]
    hit = np.zeros(int(first.max()) + 1, bool)
    hit[first[injected]] = True
    # the emptiest bins are broken up as well: their pieces look for better company
    own = np.bincount(first, sizes)
    hit |= own < np.quantile(own, 0.03)
    displaced = hit[first] & ~injected
    child = np.where(injected, second + len(hit), first).astype(np.int32)
    child[displaced] = -1
    keep = child >= 0
    child[keep] = compact(child[keep])
    kept = np.bincount(child[keep], sizes[keep]).astype(int).tolist() if keep.any() else []
    order = np.flatnonzero(displaced)
    order = order[np.argsort(-sizes[order] * rng.uniform(0.98, 1.0, len(order)), kind="stable")]
    best_fit(order, sizes.tolist(), child, kept, capacity)
    return compact(child)


def evolve(population: list[np.ndarray], sizes: np.ndarray, capacity: int, generations: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The population after all ``generations``, best first; with as few bins as can be, fuller ones are still better."""
    scored = sorted(((fitness(sizes, p, capacity), i, p) for i, p in enumerate(population)), key=lambda x: x[:2])
    for g in range(generations):
        a, b = rng.choice(len(scored), 2, replace=False) if len(scored) > 1 else (0, 0)
        child = crossover(scored[min(a, b)][2], scored[max(a, b)][2], sizes, capacity, rng)
        scored.append((fitness(sizes, child, capacity), len(population) + g, child))
        scored = sorted(scored, key=lambda x: x[:2])[:len(population)]
    return [p for _, _, p in scored]


def settle(sizes: np.ndarray, capacity: int, population: int, rng: np.random.Generator, pure: bool) -> list[np.ndarray]:
    """A first population: best-fit over (nearly) decreasing sizes."""
    out = []
    for k in range(population):
        order = np.argsort(-sizes * (1.0 if pure and not k else rng.uniform(0.9, 1.0, len(sizes))), kind="stable")
        bins = np.zeros(len(sizes), np.int32)
        best_fit(order, sizes.tolist(), bins, [], capacity)
        out.append(bins)
    return out


# ---------------------------------------------------------------- islands as Spark groups

_STATE = "shard long, island long, migrant boolean, sizes binary, genomes binary"


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Append sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32) of at most ``capacity`` tokens."""
    # a number per written row deals repeated rows like any others, so that no shard passes about ``shard_items``
    pieces, _ = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity)
    shards = max(1, -(-short.count() // shard_items))
    short = short.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).drop("row")

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")

    def begin(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = order(pdf)["length"].to_numpy(np.int64).tobytes()
        return pd.DataFrame([(key[0], i, False, sizes, b"") for i in range(ISLANDS)], columns=["shard", "island", "migrant", "sizes", "genomes"])

    def epoch(number: int):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            shard, island = int(key[0]), int(key[1])
            home = pdf[~pdf["migrant"]].iloc[0]
            sizes = np.frombuffer(home["sizes"], np.int64)
            rng = np.random.default_rng([shard, island, number])
            blob = home["genomes"]
            pop = list(np.frombuffer(blob, np.int32).reshape(-1, len(sizes)).copy()) if blob else settle(sizes, capacity, POPULATION, rng, island == 0)
            for g in pdf.loc[pdf["migrant"], "genomes"]:
                pop[-1] = np.frombuffer(g, np.int32).copy()
            pop = evolve(pop, sizes, capacity, GENERATIONS, rng)
            rows = [(shard, island, False, home["sizes"], np.concatenate(pop).tobytes()),
                    (shard, (island + 1) % ISLANDS, True, b"", pop[0].tobytes())]
            return pd.DataFrame(rows, columns=["shard", "island", "migrant", "sizes", "genomes"])

        return run

    state = short.select("shard", "doc_id", "piece", "length", "ids_crc32").groupBy("shard").applyInPandas(begin, _STATE)
    for number in range(EPOCHS):
        state = state.groupBy("shard", "island").applyInPandas(epoch(number), _STATE)
    state, _ = materialize(state, "islands")

    def finish(key: tuple, pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        pdf = order(pdf)
        sizes = pdf["length"].to_numpy(np.int64)
        elites = [np.frombuffer(g, np.int32) for g in states.sort_values("island")["genomes"]]
        bins = min(elites, key=lambda b: fitness(sizes, b, capacity))
        by = np.argsort(bins, kind="stable")
        total = np.concatenate([[0], np.cumsum(sizes[by])[:-1]])
        first = np.r_[True, bins[by][1:] != bins[by][:-1]]
        offset = np.empty(len(sizes), np.int64)
        offset[by] = total - np.maximum.accumulate(np.where(first, total, 0))
        return pdf.assign(sequence_id=(int(key[0]) << 20) + bins.astype(np.int64), offset=offset).drop(columns="shard")

    # the migrants of the last epoch are the islands' elites
    elites = state.where("migrant")
    packed = short.groupBy("shard").cogroup(elites.groupBy("shard")).applyInPandas(finish, f"{PIECE}, sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity).drop("row").withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack; one row per piece."""
    return pack(cut_pieces(df, id_col, text_col, tokenizer or default_path(), end_id, capacity), capacity)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
