"""Structured features.

One-hot encoding is Spark ML: ``StringIndexer(handleInvalid="keep",
stringOrderType="alphabetAsc")`` + ``OneHotEncoder(dropLast=True)``. With
"keep" the indexer appends one slot for unseen/null values and dropLast
removes exactly that slot, so a column with L levels contributes L slots and
an unseen or null value encodes to all zeros. Vectors stay sparse.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder, OneHotEncoderModel, SQLTransformer, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.numeric import to_double
from cohortspark.operators.ranking import global_rank
from cohortspark.schema import (
    CAT_COLS, NUMERIC_COLS, UNKNOWN_TOKEN, assert_columns_present, validate_no_geo_in_categoricals,
)

CAT_VEC = "cat_vec"
NUM_VEC = "num_vec"
TEXT_VEC = "text_vec"


def categorical_frame(df: DataFrame, cat_cols: Sequence[str] = CAT_COLS,
                      unknown_token: str = UNKNOWN_TOKEN) -> DataFrame:
    """Categorical columns as strings; absent ones filled with ``unknown_token``."""
    validate_no_geo_in_categoricals(cat_cols)
    return df.withColumns({c: (F.col(f"`{c}`").cast("string") if c in df.columns
                               else F.lit(unknown_token)) for c in cat_cols})


def numeric_block(df: DataFrame, num_cols: Sequence[str] = NUMERIC_COLS, *,
                  fillna_value: float = 0.0) -> DataFrame:
    """P5: numeric columns coerced to double (bad / NaN → fill value)."""
    assert_columns_present(df, num_cols, name="numeric block")
    return df.withColumns({c: F.coalesce(to_double(F.col(f"`{c}`")), F.lit(fillna_value))
                           for c in num_cols})


def _idx(c: str) -> str:
    return f"{c}__idx"


def _ohe(c: str) -> str:
    return f"{c}__ohe"


def _num(c: str) -> str:
    return f"{c}__index"


def categorical_encoder(cat_cols: Sequence[str] = CAT_COLS) -> Pipeline:
    validate_no_geo_in_categoricals(cat_cols)
    cols = list(cat_cols)
    return Pipeline(stages=[
        StringIndexer(inputCols=cols, outputCols=[_idx(c) for c in cols], handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=[_idx(c) for c in cols], outputCols=[_ohe(c) for c in cols],
                      dropLast=True),
        VectorAssembler(inputCols=[_ohe(c) for c in cols], outputCol=CAT_VEC),
    ])


def fit_categorical_encoder(df: DataFrame, cat_cols: Sequence[str] = CAT_COLS, *,
                            index_cols: Sequence[str] = ()) -> PipelineModel:
    """M1: one distributed pass collects the levels of every column.

    Every column is one-hot encoded (reference behaviour) but those that the
    caller names in ``index_cols``: they enter ``cat_vec`` as one index feature
    (``col__index``) each. The size of the data never decides.
    """
    frame = categorical_frame(df, cat_cols)
    if not index_cols:
        return categorical_encoder(cat_cols).fit(frame)
    cols = list(cat_cols)
    si = StringIndexer(inputCols=cols, outputCols=[_idx(c) for c in cols], handleInvalid="keep",
                       stringOrderType="alphabetAsc").fit(frame)
    wide = [c for c in cols if c not in index_cols]
    stages = [si]
    if wide:
        stages.append(OneHotEncoder(inputCols=[_idx(c) for c in wide], outputCols=[_ohe(c) for c in wide],
                                    dropLast=True).fit(si.transform(frame.limit(1))))
    narrow = [c for c in cols if c not in wide]
    if narrow:
        # Plain numbers (the arithmetic drops the nominal metadata, so trees
        # split on the index as an ordered value, not as a many-valued category).
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(
            f"`{_idx(c)}` + 0.0 AS `{_num(c)}`" for c in narrow) + " FROM __THIS__"))
    inputs = [_ohe(c) if c in wide else _num(c) for c in cols]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=CAT_VEC))
    return PipelineModel(stages)


def onehot_columns(model: PipelineModel, cat_cols: Sequence[str] = CAT_COLS) -> list[str]:
    ohe = [s for s in model.stages if isinstance(s, OneHotEncoderModel)]
    if not ohe:
        return []
    ins = set(ohe[0].getInputCols())
    return [c for c in cat_cols if _idx(c) in ins]


def encode_categoricals(df: DataFrame, model: PipelineModel, cat_cols: Sequence[str] = CAT_COLS) -> DataFrame:
    """M2: add the sparse ``cat_vec`` column (narrow transform, no shuffle)."""
    out = model.transform(categorical_frame(df, cat_cols))
    return out.drop(*[x for c in cat_cols for x in (_ohe(c), _num(c), _idx(c)) if x in out.columns])


def category_labels(model: PipelineModel) -> list[list[str]]:
    return [list(x) for x in model.stages[0].labelsArray]


def cat_feature_names(model: PipelineModel, cat_cols: Sequence[str] = CAT_COLS) -> list[str]:
    """``col_value`` names in vector order (``col__index`` for index-encoded columns)."""
    wide = set(onehot_columns(model, cat_cols))
    out = []
    for c, labels in zip(cat_cols, category_labels(model)):
        out += [f"{c}_{v}" for v in labels] if c in wide else [f"{c}__index"]
    return out


def level_table(df: DataFrame, cat_cols: Sequence[str] = CAT_COLS) -> DataFrame:
    """``(col, level, idx, position, n)`` dictionary of all levels, made and kept on the executors.

    ``idx`` is the level's place within its column (ascending), ``position`` its place in the
    one-hot block, ``n`` the rows that hold it.
    """
    frame = categorical_frame(df, cat_cols)
    entries = F.array(*[F.struct(F.lit(i).alias("col_no"), F.lit(c).alias("col"), F.col(f"`{c}`").alias("level")) for i, c in enumerate(cat_cols)])
    levels = frame.select(F.inline(entries)).where(F.col("level").isNotNull()).groupBy("col_no", "col", "level").agg(F.count(F.lit(1)).alias("n"))
    ranked = global_rank(levels, "col_no", "level", rank_col="position", start=0)
    first = ranked.groupBy("col").agg(F.min("position").alias("first"))  # one row per column
    return (ranked.join(F.broadcast(first), "col")
                  .select("col", "level", (F.col("position") - F.col("first")).cast("int").alias("idx"), F.col("position").cast("int").alias("position"), "n"))


#: Levels that hold more than this share of all entries are joined by broadcast; there are fewer than 4096 of them.
HOT_SHARE = 1 / 4096


def onehot_long(df: DataFrame, levels: DataFrame, key_cols: Sequence[str],
                cat_cols: Sequence[str] = CAT_COLS, *, num_offset: int = 0) -> DataFrame:
    """Sparse entries of the one-hot block as ``(key…, feature, position, value)``.

    Values meet the dictionary of ``level_table`` by (column, level): frequent levels, of which
    there is a bounded number, by broadcast, so that no task takes a hot level's rows; all others by shuffle.
    Unknown and null values have no entry.
    """
    frame = categorical_frame(df, cat_cols)
    entries = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").alias("level")) for c in cat_cols])
    exploded = frame.select(*key_cols, F.inline(entries))
    total = levels.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") > total * HOT_SHARE
    hot, rest = levels.where(is_hot).select("col", "level", "position"), levels.where(~is_hot).select("col", "level", "position")
    known = exploded.join(F.broadcast(hot), ["col", "level"])
    if not rest.isEmpty():
        left = exploded.join(F.broadcast(hot.select("col", "level")), ["col", "level"], "left_anti")
        known = known.unionByName(left.join(rest, ["col", "level"]))
    return known.select(*key_cols, F.concat_ws("_", "col", "level").alias("feature"),
                        (F.col("position") + F.lit(num_offset)).alias("position"),
                        F.lit(1.0).alias("value"))


def text_vector(df: DataFrame, emb_col: str = "embedding") -> DataFrame:
    """array<float> embedding → ML vector column ``text_vec``."""
    return df.withColumn(TEXT_VEC, array_to_vector(F.col(emb_col)))


def assemble_features(df: DataFrame, *, num_cols: Sequence[str] = NUMERIC_COLS,
                      with_cat: bool = True, with_text: bool = False,
                      output_col: str = "features") -> DataFrame:
    """M5/M6: ``features = [numeric…, cat_vec, text_vec]`` (manifest order)."""
    inputs = list(num_cols) + ([CAT_VEC] if with_cat else []) + ([TEXT_VEC] if with_text else [])
    return VectorAssembler(inputCols=inputs, outputCol=output_col,
                           handleInvalid="error").transform(df)


def feature_names(num_cols: Sequence[str], cat_names: Sequence[str], text_dim: int = 0) -> list[str]:
    """Names in vector order; embeddings as ``text_emb_000``."""
    return list(num_cols) + list(cat_names) + [f"text_emb_{i:03d}" for i in range(text_dim)]
