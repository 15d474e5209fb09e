"""A corpus pipeline: toxicity filter, near-duplicate removal, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which ``run`` writes as Parquet to the shared folder and reads again. All but
the last return the columns of their input. Stages look only at doc_id and text, by position under private names, so extra columns of any
name pass through. Null and empty texts are clean documents and stay (equal texts count as copies, and one of them stays). Null ids are kept and never
joined on; repeated rows are copies. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import plain, scratch
from cohortspark.llm.decontaminate import leaks
from cohortspark.llm.near_dedup import near_duplicates
from cohortspark.llm.packing import pack_documents
from cohortspark.llm.substring_dedup import remove_repeats
from cohortspark.llm.toxicity import score_documents


def _private(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The frame under private column names, and the names of doc_id and text."""
    names = [f"_p{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def _public(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[f"_p{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject."""
    rows, doc_id, text = _private(docs)
    labels = plain(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "toxic")
    return _public(score_documents(rows, labels, doc_id, text).where("predicted = 0"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least id."""
    rows, doc_id, text = _private(docs)
    kept = near_duplicates(rows.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "id", "text").where("kept").select("id", "key").distinct()
    rows = rows.withColumn("_key", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    joined = rows.join(kept, (F.col("_key") == F.col("key")) & F.col(doc_id).eqNullSafe(F.col("id")), "left_semi")
    return _public(joined.dropDuplicates([doc_id, "_key"]), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that stand elsewhere too; every document stays."""
    rows, _, text = _private(docs)
    out = remove_repeats(rows, text, whole_characters=True)
    cleaned = F.when(F.col("n_removed") > 0, F.decode("kept", "UTF-8")).otherwise(F.col(text))
    out = out.withColumn(text, cleaned)
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        out = out.withColumn(f"_p{at}", F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col(f"_p{at}")).cast(docs.dtypes[at][1]))
    return _public(out, docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    rows, _, text = _private(docs)
    bench = plain(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")
    rows = rows.withColumn("_key", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    found = leaks(rows.select("_key", F.col(text).alias("text")), bench, id_col="_key").select("_key").distinct()
    return _public(rows.join(found, "_key", "left_anti"), docs)


def pack_rest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces in sequences of 1024 tokens."""
    return pack_documents(plain(docs, "doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack_rest),
]

#: SQL cannot express the stages (learned scores, samples, evolved packings); tests/llm checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
