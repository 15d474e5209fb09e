"""Filter interaction audit: what each filter removes in every order of application, by a Gray-code walk over filter subsets.

Five filters judge a text (its failures form a 5-bit mask, A the lowest bit): under 50 words; under 65 % distinct words; over 5 % A-Z letters;
holds one of #$%&*|; equals the text of a smaller id anywhere in the table. Documents, good and toxic ones are counted by part and mask: at most 32 cells
a part, summed before the shuffle. The walk then visits all 32 filter subsets in Gray-code order, so that one filter is switched on or off
at a time: each cell keeps a counter of its active failures, and a cell that leaves or returns to 0 leaves or joins the running survivors. The 32
states are stored; a step of an order is the difference of two of them.

Everything per document runs in the JVM. Equal texts are found by their SHA-256, grouped with partial sums; groups that hold more than a fixed share
of all rows (so a bounded number) are joined back by broadcast, the others by shuffle. Labels meet (doc_id, part, mask) rows that were added up first,
so that a hot id is one row.

Edge cases: null texts are empty, null parts the empty string. An empty text has no word: it fails A, not B, C or D, and E like any other text. Null ids
are neither smaller nor larger than others: such rows never fail E, and cause no failure. Repeated rows with one id do not fail E
through each other; each counts. Of repeated labels of a document the largest counts; documents without a label are neither good nor toxic; labels
without a document are ignored. An empty table gives no row. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import join_unique, materialize, plain

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
MEASURES = ("n", "good", "toxic")
OUT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
       "good_lost long, toxic_lost long, shapley long")


def text_failures(text: Column) -> Column:
    """Failures of filters A to D as a mask."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask) of every row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_failures(text).alias("mask"))
    rows, _ = materialize(rows, "masks")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    joined = join_unique(rows, groups, "digest", "n")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return joined.select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def cell_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic); ``labels`` has doc_id, quality and toxic."""
    rows, _ = materialize(masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")), "cells")
    marked = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
                                          F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")).where("good + toxic > 0")
    lost = rows.join(marked, "doc_id").select("part", "mask", F.lit(0).cast("long").alias("n"), (F.col("n") * F.col("good")).alias("good"),
                                              (F.col("n") * F.col("toxic")).alias("toxic"))
    every = rows.select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return every.unionByName(lost).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in MEASURES])


def walk(cells: np.ndarray) -> np.ndarray:
    """Survivors of all 32 filter subsets: ``cells`` is (parts, mask, measures), the result (parts, subset, measures)."""
    state = np.zeros_like(cells)
    failing = np.zeros(CELLS, np.int64)  # active failures of each cell
    alive, subset = cells.sum(1), 0
    state[:, 0] = alive
    mask = np.arange(CELLS)
    for i in range(1, CELLS):
        bit = i & -i  # the filter that the Gray code toggles
        subset ^= bit
        change = 1 if subset & bit else -1
        hit = (mask & bit) != 0
        gone = hit & (failing == 0) if change > 0 else hit & (failing == 1)
        failing[hit] += change
        alive = alive - change * cells[:, gone].sum(1)
        state[:, subset] = alive
    return state


def audit_tables(cells: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of every (part, order, step), from the cells of the parts."""
    orders = np.array(list(permutations(range(len(FILTERS)))))
    state = walk(cells)
    bits = 1 << orders
    after = np.cumsum(bits, 1)
    before = after - bits
    mask = np.arange(CELLS)
    fails = np.stack([cells[:, (mask & 1 << f) != 0, 0].sum(1) for f in range(len(FILTERS))], 1)
    lost = state[:, before] - state[:, after]
    removed = lost[..., 0]
    shapley = np.stack([(removed * (orders == f)).sum((1, 2)) for f in range(len(FILTERS))], 1)
    return {"kept": state[:, after, 0], "removed": removed, "redundant": fails[:, orders] - removed, "unique_fails": cells[:, 1 << orders, 0],
            "good_lost": lost[..., 1], "toxic_lost": lost[..., 2], "shapley": shapley[:, orders]}


def audit(cells: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    names = ["".join(p) for p in permutations(FILTERS)]
    steps = len(FILTERS)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                table = np.zeros((piece.num_rows, CELLS, len(MEASURES)), np.int64)
                found = piece.column("cells")
                row = np.repeat(np.arange(piece.num_rows), np.diff(np.asarray(found.offsets)))
                flat = found.flatten()
                at = np.asarray(flat.field("mask"))
                for k, c in enumerate(MEASURES):
                    table[row, at, k] = np.asarray(flat.field(c))
                out = audit_tables(table)
                n = len(names) * steps
                yield pa.RecordBatch.from_pydict({
                    "part": [p for p in piece.column("part").to_pylist() for _ in range(n)],
                    "filter_order": [o for o in names for _ in range(steps)] * piece.num_rows,
                    "step": pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names) * piece.num_rows)),
                    **{k: pa.array(v.ravel()) for k, v in out.items()}})

    # at most 32 cells a part
    packed = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))
    return packed.mapInArrow(part, OUT)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source")
    labels = plain(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "quality", "toxic")
    return audit(cell_counts(failure_masks(docs), labels))


#: SQL restatement: every order is applied step by step to the masks of the documents.
ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS MATERIALIZED (
  SELECT doc_id, part,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS MATERIALIZED (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE length(replace(replace(replace(replace(replace('ABCDE', a.f, ''), b.f, ''), c.f, ''), d.f, ''), e.f, '')) = 0),
st AS MATERIALIZED (
  SELECT filter_order, CAST(step AS INTEGER) AS step, f.bit, coalesce((SELECT sum(g.bit) FROM f g WHERE contains(substr(filter_order, 1, step - 1), g.f)), 0) AS before
  FROM o, range(1, 6) r(step) JOIN f ON f.f = substr(filter_order, step, 1)),
parts AS (SELECT DISTINCT part FROM c),
x AS (
  SELECT part, filter_order, step, any_value(st.bit) AS bit,
    coalesce(sum(n) FILTER (WHERE mask & CAST(before + bit AS INTEGER) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE mask & CAST(before AS INTEGER) = 0 AND mask & bit > 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & CAST(before AS INTEGER) > 0 AND mask & bit > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & CAST(before AS INTEGER) = 0 AND mask & bit > 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & CAST(before AS INTEGER) = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM parts JOIN c USING (part), st GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM x
"""
