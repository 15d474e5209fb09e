"""Quality classifier: a byte-level convolutional network in numpy, trained on the executors.

Bytes are embedded; learned filters look at windows of WIDTH bytes, every STRIDE bytes. Texts are cut into overlapping chunks of two hops (each hop but
the first and last belongs to two chunks), which cover the whole document whatever its length. A chunk keeps each filter's largest response; a
hidden layer reads these, its units are max-pooled over all chunks of the document, and a logistic unit combines them into one probability.
Chunk responses are low where a text repeats itself, so the hidden units can tell monotony as well as odd symbols or capitals.

Training is data-parallel: a bounded sample is dealt to SHARDS shards; in each round a task trains on its shard alone (Adam, STEPS
minibatches) and returns its weights, which the driver averages (a few thousand numbers a shard). The sample: of each label at most about FIT_ROWS documents,
chosen by a hash of the id, none longer than FIT_BYTES; the classes weigh the same, and the score is shifted to the share of the labels afterwards.
A shard thus holds at most 2 FIT_ROWS / SHARDS texts. Scoring reads every document whole, in steps of bounded size.

Edge cases: null and empty texts are padding only and have a score like any other. Null labels are ignored; of repeated labels of a document the
largest counts, and of repeated ids one text (the greatest) is learned from. Ids that are null are scored, never learned from. With labels of one kind only, every
score is that label; without any, 0.5. A score depends on the text and the model only, so repeated rows score alike. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import crc_of, materialize, plain

#: Bounds of the training sample: rows of each label, bytes of a text.
FIT_ROWS, FIT_BYTES = 3000, 1 << 17
SHARDS, ROUNDS, STEPS, BATCH = 8, 6, 30, 32
WIDTH, STRIDE, HOP = 12, 2, 256
DIM, FILTERS, HIDDEN = 8, 32, 16
PAD = 256
RATE = 4e-3
#: Share of positive labels from which a document is predicted good.
THRESHOLD = 0.3
STEP_BYTES = 1 << 20
_SHAPES = {"embed": (257, DIM), "filters": (WIDTH * DIM, FILTERS), "bias": (FILTERS,), "dense": (FILTERS, HIDDEN), "shift": (HIDDEN,), "out": (HIDDEN,), "base": (1,)}
SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The weights by name, as views of one flat array."""
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at:at + n].reshape(shape)
        at += n
    return out


def fresh_weights(seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    flat = np.zeros(SIZE, np.float32)
    w = views(flat)
    w["embed"][:PAD] = rng.normal(0, 0.5, (PAD, DIM))
    w["filters"][:] = rng.normal(0, (WIDTH * DIM) ** -0.5, _SHAPES["filters"])
    w["dense"][:] = rng.normal(0, FILTERS ** -0.5, _SHAPES["dense"])
    w["shift"][:] = 0.1
    w["out"][:] = rng.normal(0, HIDDEN ** -0.5, HIDDEN)
    return flat


# ---------------------------------------------------------------- the network

class Layout:
    """Texts laid out in whole hops, each followed by at least WIDTH bytes of padding."""

    def __init__(self, texts: list[bytes]):
        self.hops = np.array([(len(t) + WIDTH + HOP - 1) // HOP for t in texts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.hops)])
        self.codes = np.full(self.begin[-1] * HOP + WIDTH, PAD, np.uint16)
        for t, b in zip(texts, self.begin):
            self.codes[b * HOP:b * HOP + len(t)] = np.frombuffer(t, np.uint8)
        self.last = self.begin[1:] - 1
        # a chunk begins at every hop but a document's last, unless it is the only one
        starts = np.ones(self.begin[-1], bool)
        starts[self.last[self.hops > 1]] = False
        self.chunk = np.flatnonzero(starts)
        self.after = np.minimum(self.chunk + 1, np.repeat(self.last, np.maximum(self.hops - 1, 1)))
        self.first_chunk = np.concatenate([[0], np.cumsum(np.maximum(self.hops - 1, 1))])

    def windows(self, at: np.ndarray) -> np.ndarray:
        """Byte codes of the windows that begin at the given positions."""
        return self.codes[at[:, None] + np.arange(WIDTH)]


def hop_maxima(w: dict[str, np.ndarray], lay: Layout, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(largest response of each filter in each hop, the window's position in the hop if asked)."""
    n, per = int(lay.begin[-1]), HOP // STRIDE
    out = np.empty((n, FILTERS), w["filters"].dtype)
    where = np.empty((n, FILTERS), np.int64) if places else None
    inside = (HOP - WIDTH) // STRIDE + 1  # windows of a document's last hop that do not pass its end
    is_last = np.zeros(n, bool)
    is_last[lay.last] = True
    for lo in range(0, n, 64):
        hi = min(n, lo + 64)
        x = w["embed"][lay.codes[lo * HOP:hi * HOP + WIDTH]]
        s = x.itemsize
        rows = np.lib.stride_tricks.as_strided(x, ((hi - lo) * per, WIDTH * DIM), (STRIDE * DIM * s, s))
        z = (np.ascontiguousarray(rows) @ w["filters"]).reshape(hi - lo, per, FILTERS)
        z[is_last[lo:hi], inside:] = -np.inf
        if places:
            where[lo:hi] = z.argmax(1)
        out[lo:hi] = z.max(1)
    return out, where


def forward(w: dict[str, np.ndarray], lay: Layout, places: bool = False):
    """(logit of each document, everything the backward pass needs)."""
    top, where = hop_maxima(w, lay, places)
    seen = np.maximum(np.maximum(top[lay.chunk], top[lay.after]) + w["bias"], 0)
    hidden = np.maximum(seen @ w["dense"] + w["shift"], 0)
    pooled = np.maximum.reduceat(hidden, lay.first_chunk[:-1], axis=0) if len(lay.hops) else np.zeros((0, HIDDEN), np.float32)
    return pooled @ w["out"] + w["base"][0], (top, where, seen, hidden, pooled)


def gradient(flat: np.ndarray, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """(weighted log loss, its gradient) over a minibatch."""
    w, lay = views(flat), Layout(texts)
    logit, (top, where, seen, hidden, pooled) = forward(w, lay, True)
    p = 1 / (1 + np.exp(-logit.astype(float)))
    share = weight / weight.sum()
    loss = float(-(share * np.where(y == 1, np.log(p + 1e-12), np.log(1 - p + 1e-12))).sum())
    out = np.zeros_like(flat)
    g = views(out)
    up = (share * (p - y)).astype(flat.dtype)
    g["out"][:], g["base"][0] = pooled.T @ up, up.sum()
    # each hidden unit passes its gradient to the chunk that held the maximum
    down = np.zeros_like(hidden)
    units = np.arange(HIDDEN)
    for i, (a, b) in enumerate(zip(lay.first_chunk, lay.first_chunk[1:])):
        down[a + hidden[a:b].argmax(0), units] += up[i] * w["out"]
    down *= hidden > 0
    g["dense"][:], g["shift"][:] = seen.T @ down, down.sum(0)
    below = (down @ w["dense"].T) * (seen > 0)
    g["bias"][:] = below.sum(0)
    # and each filter to the one window that held the chunk's maximum
    row, unit = np.nonzero(below)
    amount = below[row, unit]
    a, b = lay.chunk[row], lay.after[row]
    hop = np.where(top[a, unit] >= top[b, unit], a, b)
    codes = lay.windows(hop * HOP + where[hop, unit] * STRIDE)
    x = w["embed"][codes].reshape(len(codes), WIDTH * DIM) * amount[:, None]
    onehot = np.zeros((len(unit), FILTERS), flat.dtype)
    onehot[np.arange(len(unit)), unit] = 1
    g["filters"][:] = x.T @ onehot
    back = (w["filters"].T[unit] * amount[:, None]).reshape(-1, DIM)
    for d in range(DIM):
        g["embed"][:, d] = np.bincount(codes.ravel(), back[:, d], 257)
    g["embed"][PAD] = 0  # padding stays at zero
    return loss, out


# ---------------------------------------------------------------- training

def train_shard(state: np.ndarray, texts: list[bytes], y: np.ndarray, weight: np.ndarray, seed: int, done: int) -> np.ndarray:
    """STEPS steps of Adam from ``state`` (weights, first and second moments); ``done`` steps have gone before."""
    flat, m, v = state.reshape(3, SIZE).copy()
    rng = np.random.default_rng(seed)
    order = np.zeros(0, np.int64)
    total = ROUNDS * STEPS
    for t in range(done + 1, done + STEPS + 1):
        while len(order) < min(BATCH, len(texts)):
            order = np.concatenate([order, rng.permutation(len(texts))])
        pick, order = order[:BATCH], order[BATCH:]
        _, g = gradient(flat, [texts[i] for i in pick], y[pick], weight[pick])
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        rate = RATE * min(1.0, 1.1 - t / total)
        flat -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return np.concatenate([flat, m, v])


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> tuple[DataFrame, dict[int, int]]:
    """((doc_id, text, y, shard) of a bounded sample of the rows to learn from, their number by label)."""
    y = F.max(F.col(label).cast("int")).alias("y")
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(y)
    rows = rows.where(F.pmod(crc_of("doc_id"), F.lit(5)) != 0)
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    every = F.when(F.col("y") == 1, -(-sizes.get(1, 1) // FIT_ROWS)).otherwise(-(-sizes.get(0, 1) // FIT_ROWS))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), every) == 0)
    # about 2 FIT_ROWS rows of two numbers, whatever the table
    texts = docs.where(F.octet_length(F.coalesce("text", F.lit(""))) <= FIT_BYTES).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id", "y").agg(F.max("text").alias("text"))
    return one.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(SHARDS)).cast("int")), sizes


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, float] | float:
    """(weights, shift of the log odds); a constant score if the labels are of one kind or absent."""
    spark = docs.sparkSession
    sample, sizes = labelled(docs, labels, label)
    sample, _ = materialize(sample, "quality-sample")
    found = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(found) != {0, 1}:
        return sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    dealt = sample.repartitionByRange(SHARDS, "shard").sortWithinPartitions("shard", F.xxhash64("doc_id", F.lit(13)), "doc_id")
    dealt = dealt.select("shard", "y", F.coalesce("text", F.lit("")).cast("binary").alias("text")).persist()
    state = np.concatenate([fresh_weights(), np.zeros(2 * SIZE, np.float32)])

    def round_of(number: int, shared):
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a partition may hold several shards; each is trained on its own, so the result does not depend on the layout
            held: dict[int, tuple[list[bytes], list[int]]] = {}
            for batch in batches:
                for shard, y, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    texts, ys = held.setdefault(shard, ([], []))
                    texts.append(text)
                    ys.append(y)
            for shard, (texts, ys) in held.items():
                y = np.array(ys)
                weight = np.where(y == 1, 1 / found[1], 1 / found[0])
                after = train_shard(shared.value, texts, y, weight, 1000 * number + shard, number * STEPS)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "state": [after.astype(np.float32).tobytes()]})
        return part

    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast(state)
        rows = sorted(dealt.mapInArrow(round_of(number, shared), "shard int, state binary").collect())
        state = np.mean([np.frombuffer(r["state"], np.float32) for r in rows], 0, dtype=np.float64).astype(np.float32)
        shared.unpersist()
    dealt.unpersist()
    return state[:SIZE], float(np.log(sizes[1] / sizes[0]))


# ---------------------------------------------------------------- scoring

def text_scores(model: tuple[np.ndarray, float], texts: list[bytes]) -> np.ndarray:
    """Probability of the label 1 for each text, in steps of about STEP_BYTES."""
    w, out, lo = views(model[0]), np.zeros(len(texts)), 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) <= STEP_BYTES and hi - lo < 4096:
            size += len(texts[hi])
            hi += 1
        logit, _ = forward(w, Layout(texts[lo:hi]))
        out[lo:hi] = 1 / (1 + np.exp(-(logit.astype(float) + model[1])))
        lo = hi
    return out


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """Append score (0 to 1) and predicted (1 from THRESHOLD on) to every row of ``docs``; ``labels`` has doc_id and the label."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    model = fit(base, labels.select("doc_id", label), label)
    if isinstance(model, float):
        return docs.withColumns({"score": F.lit(model), "predicted": F.lit(int(model >= THRESHOLD))})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield pd.Series(text_scores(shared.value, [bytes(x) if x is not None else b"" for x in s]))

    out = docs.withColumn("score", score(F.col(f"`{text_col}`").cast("string").cast("binary")))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op11_quality(spark, sf_dir: str) -> DataFrame:
    docs = plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    scored = score_documents(docs, plain(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "quality"))
    return scored.select("doc_id", (F.pmod(crc_of("doc_id"), F.lit(5)) == 0).alias("held_out"), "score", "predicted")
