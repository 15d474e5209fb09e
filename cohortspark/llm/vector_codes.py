"""Vector code compression: integer product codes, assigned by Orchard's search.

Each component becomes floor(scale * x); vectors are cut into ``parts`` equal consecutive parts with a codebook of ``entries`` entries each.
A codebook starts as that part of the vectors with the smallest ids. A round assigns every part to its nearest entry (squared Euclidean
distance, ties to the lower index) and moves each entry to the floor of its parts' mean; unused entries stay.

Orchard's search keeps, for every entry, the other entries sorted by their distance from it. A vector looks along its current entry's list; when
an entry is nearer it jumps to that entry's list. Visited entries are marked and not measured again, and the search ends where the list goes
beyond twice the vector's current distance: by the triangle inequality everything farther is strictly worse, so the result is exact, ties included.

Every pass reads the written integer rows once; a task returns the sums and counts of each entry (parts * entries rows, whatever the table), and
the driver holds codebooks only. Error sums by label are joined back in two ways: the few labels that hold more than a fixed share of all rows
by broadcast (their number is bounded by that share), all others by shuffle.

Edge cases: rows whose vector is null, empty or holds null or non-finite components are dropped. Vectors must have one length; with several, the
commonest one counts (ties: the longest) and rows of others are dropped as not comparable. A length that ``parts`` does not divide gives parts that
differ by one component. With fewer kept rows than ``entries`` the codebooks have one entry a row. Null ids sort last, equal ids by their vectors;
repeated rows count as often as they stand there. Null labels form one group. An empty table gives no row. Components whose integer
passes 2^23 in size raise an error, since sums of their squares could pass 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import join_unique, materialize, plain

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows that one numpy step works on.
STEP_ROWS = 8192
LIMIT = 1 << 23


class Codebook:
    """Entries of one part with, for each entry, the others in order of their distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gap = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        np.fill_diagonal(gap, -1)  # an entry heads its own list, before entries equal to it
        self.order = np.argsort(gap, 1, kind="stable")[:, 1:]
        self.gap = np.take_along_axis(gap, self.order, 1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each row of ``x``."""
        n, last = len(x), self.order.shape[1]
        at, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        best = ((x - self.entries[0]) ** 2).sum(1)
        seen = np.zeros((n, len(self.entries)), bool)
        seen[:, 0] = True
        live = np.arange(n if last else 0)
        while len(live):
            here, p = at[live], place[live]
            # squared: beyond twice the distance means beyond four times its square
            on = (p < last) & (self.gap[here, np.minimum(p, last - 1)] <= 4 * best[live])
            live, here, p = live[on], here[on], p[on]
            found = self.order[here, p]
            place[live] += 1
            fresh = ~seen[live, found]
            rows, found = live[fresh], found[fresh]
            seen[rows, found] = True
            d = ((x[rows] - self.entries[found]) ** 2).sum(1)
            better = (d < best[rows]) | ((d == best[rows]) & (found < at[rows]))
            rows = rows[better]
            at[rows], best[rows], place[rows] = found[better], d[better], 0
        return at, best


def cuts(size: int, parts: int) -> list[tuple[int, int]]:
    """(begin, end) of the parts of a vector of ``size`` components."""
    return [(p * size // parts, (p + 1) * size // parts) for p in range(parts)]


def integer_rows(df: DataFrame, vec_col: str, scale: int) -> tuple[DataFrame, int]:
    """(rows with the vector as integers ``q``, vector length): unusable vectors are gone."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(v.isNotNull() & (F.size(v) > 0)).where(fine)
    rows = rows.withColumn("q", F.transform(v, lambda x: F.floor(x.cast("double") * scale))).drop(vec_col)
    rows, _ = materialize(rows, "integer-vectors")
    length = rows.groupBy(F.size("q").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return (rows, 0) if length is None else (rows.where(F.size("q") == length["size"]), length["size"])


def _steps(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors as a matrix."""
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP_ROWS):
            piece = batch.slice(lo, STEP_ROWS)
            q = np.asarray(piece.column("q").flatten()).reshape(-1, size)
            if np.abs(q).max(initial=0) > LIMIT:
                raise ValueError(f"a component passes {LIMIT} after scaling; use a smaller scale")
            yield piece, q


def _totals(rows: DataFrame, books: list[Codebook], size: int) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of the rows assigned to each entry, by part * 2^16 + entry."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    spans = cuts(size, len(books))
    width = max(b - a for a, b in spans)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        k = len(books[0].entries)
        n, total = np.zeros((len(books), k), np.int64), np.zeros((len(books), k, width), np.int64)
        for _, q in _steps(batches, size):
            for p, (a, b) in enumerate(spans):
                at, _ = books[p].nearest(q[:, a:b])
                n[p] += np.bincount(at, minlength=k)
                # sums of a step stay far below 2^53, so products in doubles are exact
                total[p, :, :b - a] += (np.eye(k)[:, at] @ q[:, a:b]).astype(np.int64)
        used = np.argwhere(n > 0)
        yield pa.RecordBatch.from_pydict({"cell": pa.array([int(p) << 16 | int(e) for p, e in used], pa.int32()), "n": pa.array([n[p, e] for p, e in used], pa.int64()),
                                          "total": pa.array([total[p, e] for p, e in used], pa.list_(pa.int64()))})

    sums = rows.select("q").mapInArrow(part, "cell int, n long, total array<long>").groupBy("cell")
    out = sums.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total")).collect()
    shared.unpersist()
    return {r["cell"]: (r["n"], r["total"]) for r in out}


def train_codebooks(rows: DataFrame, id_col: str, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The final entries of every part; ``rows`` has integer vectors ``q`` of ``size`` components."""
    first = rows.select(id_col, "q").orderBy(F.col(id_col).asc_nulls_last(), "q").limit(entries).collect()
    start = np.array([r["q"] for r in first], np.int64).reshape(len(first), size)
    if np.abs(start).max(initial=0) > LIMIT:
        raise ValueError(f"a component passes {LIMIT} after scaling; use a smaller scale")
    books = [start[:, a:b].copy() for a, b in cuts(size, parts)]
    for _ in range(rounds if len(start) else 0):
        for cell, (n, total) in _totals(rows, [Codebook(b) for b in books], size).items():
            book = books[cell >> 16]
            book[cell & 0xFFFF] = np.array(total[:book.shape[1]], np.int64) // n
    return books


def compress_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", *,
                     parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, code, error, label_error) of every usable vector, the codebooks of the parts)."""
    spark = df.sparkSession
    named = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("v"), F.col(f"`{label_col}`").cast("string").alias("label"))
    rows, size = integer_rows(named, "v", scale)
    books = train_codebooks(rows, "id", size, parts, entries, rounds)
    id_type = dict(named.dtypes)["id"]
    if not size:
        return spark.createDataFrame([], f"`{id_col}` {id_type}, code string, error long, label_error long"), books
    shared = spark.sparkContext.broadcast([Codebook(b) for b in books])
    spans = cuts(size, parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for piece, q in _steps(batches, size):
            found = [books[p].nearest(q[:, a:b]) for p, (a, b) in enumerate(spans)]
            digits = np.stack([at for at, _ in found], 1).astype(np.uint8 if entries <= 256 else ">u2")
            width = 2 * digits.itemsize * parts
            text = digits.tobytes().hex()
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array([text[i:i + width] for i in range(0, len(text), width)], pa.string()),
                                              pa.array(sum(d for _, d in found)), piece.column("key")], names=["id", "code", "error", "key"])

    keyed = rows.select("id", "q", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")).alias("key"))
    coded, _ = materialize(keyed.mapInArrow(encode, f"id {id_type}, code string, error long, key string"), "vector-codes")
    by_label = coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = join_unique(coded, by_label, "key", "n")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error"), books


def codebooks_text(books: list[np.ndarray]) -> str:
    """All components in order of part, entry and position, comma-joined."""
    return ",".join(str(x) for book in books for x in book.ravel().tolist())


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    vectors = plain(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    out, books = compress_vectors(vectors)
    return out.withColumn("codebooks_sha256", F.lit(hashlib.sha256(codebooks_text(books).encode()).hexdigest()))


def _oracle() -> str:
    sql = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, vec_id, label, embedding FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comp AS MATERIALIZED (
  SELECT rid, (i - 1) // w AS part, (i - 1) % w AS pos, CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT) AS q
  FROM (SELECT rid, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i, len(embedding) // {PARTS} AS w FROM kept)),
c0 AS MATERIALIZED (SELECT part, rid AS entry, pos, q AS c FROM comp WHERE rid < {ENTRIES}),"""
    for r in range(ROUNDS + 1):
        sql += f"""
d{r} AS MATERIALIZED (SELECT rid, part, entry, sum((q - c) * (q - c)) AS d FROM comp JOIN c{r} USING (part, pos) GROUP BY rid, part, entry),
a{r} AS MATERIALIZED (SELECT rid, part, min(d * {ENTRIES} + entry) % {ENTRIES} AS entry, min(d) AS d FROM d{r} GROUP BY rid, part),"""
        if r < ROUNDS:
            sql += f"""
s{r} AS MATERIALIZED (SELECT part, entry, pos, sum(q) AS s, count(*) AS n FROM comp JOIN a{r} USING (rid, part) GROUP BY part, entry, pos),
c{r + 1} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN n IS NULL THEN c ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS c
  FROM c{r} LEFT JOIN s{r} USING (part, entry, pos)),"""
    return sql + f"""
coded AS (SELECT rid, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c{ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (rid)"""


#: SQL restatement: brute-force distances instead of Orchard's search.
ORACLE = _oracle()
