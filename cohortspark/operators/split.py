"""Deterministic exact-quota split by key.

Contract (not numpy's bit-exact shuffle): every distinct key gets a rank
from the order of ``md5(seed || ':' || key)`` (ties on the key itself);
ranks ``[0, n_train)`` are train, the next ``n_test`` test, the rest
holdout. All rows of a key share its split; null keys form one key.

Scale design: no global window. Keys are bucketed by the first bits of the
hash; bucket counts (bounded by ``2**bucket_bits`` rows) give exact rank
offsets. Buckets lying wholly inside one quota get their label from a range
test on the bucket id (a projection, no join); only keys in the at most two
buckets that straddle a cut are ranked, and that small key table is joined
back (broadcast when its exact size, known from the counts, is under the
limit; otherwise a shuffle join restricted to those buckets' rows).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.schema import HOLDOUT_FRAC, RANDOM_SEED, TEST_FRAC, TRAIN_FRAC, validate_fractions

NULL_KEY = "__null__"
SPLITS = ["train", "test", "holdout"]
DEFAULT_BUCKET_BITS = 16
DEFAULT_BROADCAST_KEYS = 2_000_000


def key_string(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(NULL_KEY))


def row_key(cols: Sequence[str]) -> Column:
    """Key for the row-level fallback: all columns as text (identical rows share a split)."""
    return F.concat_ws("~", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("∅"))
                              for c in cols])


def order_hash(k: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), k))


def _bucket(h: Column, bits: int) -> Column:
    return F.conv(F.substring(h, 1, bits // 4), 16, 10).cast("int")


def quotas(n: int, train_frac: float = TRAIN_FRAC, test_frac: float = TEST_FRAC,
           holdout_frac: float = HOLDOUT_FRAC, variant: str = "round") -> tuple[int, int, int]:
    """(n_train, n_test, n_holdout). ``round``: package rule (half-even);
    ``two_step``: notebook rule, holdout = ceil(h·n), test = ceil(h·rest)."""
    if variant == "round":
        n_train = min(int(round(train_frac * n)), n)
        n_test = min(int(round(test_frac * n)), n - n_train)
        return n_train, n_test, n - n_train - n_test
    if variant == "two_step":
        n_hold = min(int(math.ceil(holdout_frac * n)), n)
        n_test = min(int(math.ceil(holdout_frac * (n - n_hold))), n - n_hold)
        return n - n_hold - n_test, n_test, n_hold
    raise ValueError(f"unknown quota variant {variant!r}")


def _label_for_rank(r: Column, n_train: int, n_test: int) -> Column:
    return (F.when(r < F.lit(n_train), F.lit("train"))
            .when(r < F.lit(n_train + n_test), F.lit("test"))
            .otherwise(F.lit("holdout")))


def assign_split(df: DataFrame, *, key_col: str | None = "nct_id", seed: int = RANDOM_SEED,
                 train_frac: float = TRAIN_FRAC, test_frac: float = TEST_FRAC,
                 holdout_frac: float = HOLDOUT_FRAC, variant: str = "round",
                 bucket_bits: int = DEFAULT_BUCKET_BITS,
                 broadcast_keys: int = DEFAULT_BROADCAST_KEYS,
                 split_col: str = "split", key_cols: Sequence[str] | None = None,
                 quota_fn=None) -> DataFrame:
    """Return ``df`` with a ``split`` column (train / test / holdout).

    ``key_cols`` keys rows by several columns; ``quota_fn(n) -> (n_train,
    n_test, n_holdout)`` replaces the fraction rule (e.g. a fixed-size sample).
    """
    if quota_fn is None:
        validate_fractions(train_frac, test_frac, holdout_frac)
    if bucket_bits % 4 or not 4 <= bucket_bits <= 24:
        raise ValueError("bucket_bits must be a multiple of 4 in [4, 24]")
    if key_cols:
        k = row_key(key_cols)
    elif key_col and key_col in df.columns:
        k = key_string(F.col(f"`{key_col}`"))
    else:
        k = row_key(df.columns)
    h = order_hash(k, seed)
    keyed = df.withColumns({"_sk": k, "_sh": h, "_sb": _bucket(h, bucket_bits)})

    # Job 1: distinct keys per bucket (partial aggregation collapses hot keys map-side).
    by_row = not key_cols and not (key_col and key_col in df.columns)
    # Only the key travels: its hash and bucket are made again behind the shuffle.
    keys = df.select(k.alias("_sk"))
    keys = keys if by_row else keys.distinct()  # rows are split one by one, equal ones too
    keys = keys.withColumn("_sh", order_hash(F.col("_sk"), seed))
    keys = keys.withColumn("_sb", _bucket(F.col("_sh"), bucket_bits))
    counts = sorted((r["_sb"], r["n"]) for r in
                    keys.groupBy("_sb").agg(F.count(F.lit(1)).alias("n")).collect())
    n = sum(c for _, c in counts)
    if n == 0:
        raise ValueError("no rows to split")
    n_train, n_test, _ = (quota_fn(n) if quota_fn is not None
                          else quotas(n, train_frac, test_frac, holdout_frac, variant))
    cuts = (n_train, n_train + n_test)

    offsets, straddle, last_train, last_test = {}, [], -1, None
    start = 0
    for bucket, c in counts:
        end = start + c
        offsets[bucket] = start
        if any(start < cut < end for cut in cuts):
            straddle.append(bucket)
        elif end <= cuts[0]:
            last_train = bucket
        elif end <= cuts[1]:
            last_test = bucket
        start = end
    if last_test is None:
        last_test = last_train
    pure = (F.when(F.col("_sb") <= F.lit(last_train), F.lit("train"))
            .when(F.col("_sb") <= F.lit(last_test), F.lit("test"))
            .otherwise(F.lit("holdout")))

    if not straddle:
        out = keyed.withColumn(split_col, pure)
        return out.drop("_sk", "_sh", "_sb")

    if by_row:
        starts = F.create_map(*[x for s in straddle for x in (F.lit(s), F.lit(offsets[s]))])
        rank = starts[F.col("_sb")] - 1 + F.row_number().over(Window.partitionBy("_sb").orderBy("_sh", "_sk"))
        inside = keyed.where(F.col("_sb").isin(straddle)).withColumn(split_col, _label_for_rank(rank, n_train, n_test))
        outside = keyed.where(~F.col("_sb").isin(straddle)).withColumn(split_col, pure)
        return inside.unionByName(outside).drop("_sk", "_sh", "_sb")

    off_map = F.create_map(*[x for s in straddle for x in (F.lit(s), F.lit(offsets[s]))])
    ranked = (keys.where(F.col("_sb").isin(straddle))
              .withColumn("_rank", off_map[F.col("_sb")] - 1 + F.row_number().over(
                  Window.partitionBy("_sb").orderBy("_sh", "_sk")))
              # the key's md5 stands for its text, so that a broadcast row has a fixed size
              .select("_sh", _label_for_rank(F.col("_rank"), n_train, n_test).alias("_slabel")))
    n_straddle = sum(c for bkt, c in counts if bkt in straddle)
    if n_straddle <= broadcast_keys:
        out = (keyed.join(F.broadcast(ranked), on="_sh", how="left")
               .withColumn(split_col, F.when(F.col("_sb").isin(straddle), F.col("_slabel"))
                           .otherwise(pure)))
        return out.drop("_sk", "_sh", "_sb", "_slabel")
    inside = keyed.where(F.col("_sb").isin(straddle)).join(ranked, on="_sh", how="inner") \
        .withColumn(split_col, F.col("_slabel")).drop("_slabel")
    outside = keyed.where(~F.col("_sb").isin(straddle)).withColumn(split_col, pure)
    return inside.unionByName(outside).drop("_sk", "_sh", "_sb")


def split_dataframe(df: DataFrame, **kwargs) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = assign_split(df, **kwargs)
    return tuple(s.where(F.col("split") == name).drop("split") for name in SPLITS)


def split_sizes(df_split: DataFrame, key_col: str = "nct_id") -> DataFrame:
    """Rows and distinct keys per split."""
    return df_split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(key_string(F.col(key_col))).alias("n_keys"))


def check_disjoint(df_split: DataFrame, key_col: str = "nct_id") -> DataFrame:
    """Keys seen in more than one split (must be empty)."""
    return (df_split.groupBy(key_string(F.col(key_col)).alias("key"))
            .agg(F.count_distinct("split").alias("n_splits"))
            .where(F.col("n_splits") > 1))


def sample_n(df: DataFrame, n: int, *, key_cols: Sequence[str] | None = None,
             seed: int = RANDOM_SEED) -> DataFrame:
    """Fixed-size deterministic sample without replacement (top-n by hash of
    the row key). Planned as TakeOrderedAndProject: each task keeps ≤ n rows.
    """
    k = row_key(key_cols or df.columns)
    return (df.withColumns({"_sk": k, "_sh": order_hash(k, seed)})
              .orderBy("_sh", "_sk").limit(n).drop("_sh", "_sk"))


def stable_split(df: DataFrame, *, key_col: str = "nct_id", seed: int = RANDOM_SEED,
                 train_frac: float = TRAIN_FRAC, test_frac: float = TEST_FRAC) -> DataFrame:
    """Append-stable split (a key's split never changes as data grows);
    quotas hold only approximately. Pure projection, works on streams."""
    h = order_hash(key_string(F.col(key_col)), seed)
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(16 ** 8)
    return df.withColumn("split", F.when(u < train_frac, "train")
                         .when(u < train_frac + test_frac, "test").otherwise("holdout"))
