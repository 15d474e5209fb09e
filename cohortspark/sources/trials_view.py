"""Raw trial table derived from the driver's star-schema test tables.

One SQL text, valid unchanged in Spark SQL and DuckDB, so the oracle and
the Spark job read exactly the same rows. ``(row_id, copy_no)`` is the row
key; ``nct_id`` is the (nullable, repeating) trial key.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.session import checkpoint_dir, drop_dead_shuffles, joins_keep_dealt_rows, shuffles_end_with_jobs
from cohortspark.sources.readers import register_tables

#: Columns that follow from the order's number alone.
ROW_RULES = {
    "nct_id": "CASE WHEN o.o_orderkey % 500 = 499 THEN NULL ELSE 'NCT' || lpad(CAST(o.o_orderkey AS STRING), 8, '0') END",
    "eligibility_min_age": """CASE o.o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '18' WHEN 2 THEN '18 Years' WHEN 3 THEN '>=21' WHEN 4 THEN '65+'
    WHEN 5 THEN '6 Months' WHEN 6 THEN 'N/A' WHEN 7 THEN '40 yrs' WHEN 8 THEN '-5' WHEN 9 THEN 'nan' ELSE '70 YEARS' END""",
    "eligibility_max_age": """CASE o.o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '65 Years' WHEN 2 THEN '150 Years' WHEN 3 THEN '55.5 yr' WHEN 4 THEN '75 Y'
    WHEN 5 THEN '' ELSE '90' END""",
    "eligibility_sex": "CASE o.o_orderkey % 5 WHEN 0 THEN 'ALL' WHEN 1 THEN 'MALE' WHEN 2 THEN NULL WHEN 3 THEN 'nan' ELSE 'FEMALE' END",
    "masking": "CASE WHEN o.o_orderkey % 4 = 0 THEN 'None' ELSE 'DOUBLE' END",
    "Locations": """CASE o.o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Boston, MA, US; Austin, TX; Worcester, MA' WHEN 2 THEN 'Paris, France'
    WHEN 3 THEN 'Site A CA|Site B NV|Site C WA' WHEN 4 THEN 'NY NJ IL FL' ELSE 'MAINE xCAx ca' END""",
}

#: Shares of an order's lines, and which lines count.
LINE_RULES = {
    "white_pct": "l_returnflag='N'",
    "black_pct": "l_returnflag='R'",
    "asian_pct": "l_returnflag='A' AND l_linestatus='F'",
    "aian_pct": "l_discount>=0.095e0",
    "nhpi_pct": "l_discount<0.005e0",
    "male_pct": "l_linestatus='O'",
    "female_pct": "l_linestatus='F'",
    "age65_pct": "l_tax>=0.055e0",
}
_LINE_SHARES = "\n".join(f"    avg(CASE WHEN {rule} THEN 1e0 ELSE 0e0 END) AS {column}," for column, rule in LINE_RULES.items())

TRIALS_SQL = f"""
WITH li AS (
  SELECT l_orderkey,
{_LINE_SHARES}
    sum(l_quantity) AS enrollment_count
  FROM lineitem GROUP BY l_orderkey),
keyed AS (SELECT o.*, o_orderkey % (SELECT nullif(count(*), 0) FROM documents) AS doc_key, o_orderkey % (SELECT nullif(count(*), 0) FROM part) AS part_key,
    o_orderkey % (SELECT nullif(count(*), 0) FROM benchmark) AS item_key, (o_orderkey * 7 + 3) % (SELECT nullif(count(*), 0) FROM benchmark) AS other_key FROM orders o),
base AS (SELECT o.*, 0 AS copy_no FROM keyed o
  UNION ALL SELECT o.*, 1 AS copy_no FROM keyed o WHERE o.o_orderkey % 50 = 0)
SELECT o.o_orderkey AS row_id, o.copy_no,
  {ROW_RULES['nct_id']} AS nct_id,
  {ROW_RULES['eligibility_min_age']} AS eligibility_min_age,
  {ROW_RULES['eligibility_max_age']} AS eligibility_max_age,
  {ROW_RULES['eligibility_sex']} AS eligibility_sex,
  c.c_name AS sponsor,
  CASE WHEN o.o_orderkey % 3 = 0 THEN '' ELSE n.n_name END AS collaborators,
  o.o_orderpriority AS phases, c.c_mktsegment AS funder_type, o.o_orderstatus AS study_type,
  p.p_brand AS allocation, p.p_type AS intervention_model,
  {ROW_RULES['masking']} AS masking, r.r_name AS primary_purpose,
  {ROW_RULES['Locations']} AS Locations,
  d.text AS inclusion_text,
  CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE b2.text END AS exclusion_text,
  p.p_name AS conditions_text, '  ' || p.p_name || '   ' || p.p_type AS interventions_text,
  b.text AS primary_outcome_text,
  li.white_pct, li.black_pct, li.asian_pct, li.aian_pct, li.nhpi_pct, li.male_pct, li.female_pct, li.age65_pct,
  li.enrollment_count, CAST(o.o_custkey % 365 + 30 AS DOUBLE) AS trial_duration_days
FROM base o JOIN customer c ON c.c_custkey=o.o_custkey JOIN nation n ON n.n_nationkey=c.c_nationkey
JOIN region r ON r.r_regionkey=n.n_regionkey JOIN part p ON p.p_partkey=o.part_key
LEFT JOIN documents d ON d.doc_id=o.doc_key LEFT JOIN benchmark b ON b.item_id=o.item_key LEFT JOIN benchmark b2 ON b2.item_id=o.other_key
LEFT JOIN li ON li.l_orderkey=o.o_orderkey
"""

#: What the written view makes behind the joins, from columns of the view.
LATE = {**{column: rule.replace("o.o_orderkey", "row_id") for column, rule in ROW_RULES.items()},
        "interventions_text": "'  ' || conditions_text || '   ' || intervention_model"}

TRIAL_TABLES = ["orders", "customer", "nation", "region", "part", "documents", "benchmark", "lineitem"]

#: Tables that rows point into by their order number modulo the table's size.
DEALT_TABLES = ["documents", "part", "benchmark"]
#: A file's dictionary holds each of its texts once, so it may grow; row groups are small enough for their texts to fit.
WRITE_OPTIONS = {"parquet.dictionary.page.size": 64 << 20, "parquet.block.size": 16 << 20, "compression": "zstd"}

#: The view is written in steps of this many orders, but in no more than SLICES steps, since each step reads the tables.
SLICE_ORDERS, SLICES = 250_000, 16
#: Tables of which a step needs a part only, and the column that decides on it.
SLICE_KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey", "documents": "doc_id"}

_MATERIALIZED: dict[tuple[str, str], str] = {}


def write_trials(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Write trial rows as Parquet; texts that repeat near each other are stored once a row group."""
    df.write.mode(mode).options(**WRITE_OPTIONS).parquet(path)


def _doc_key(key: str, n_docs: int) -> Column:
    """The number of an order's document; without documents the order's own."""
    return F.col(key).cast("long") % F.lit(n_docs).cast("long") if n_docs else F.col(key).cast("long")


def _line_shares(lineitem: DataFrame, n_docs: int) -> DataFrame:
    """``li`` of ``TRIALS_SQL``; a line travels as its key, one bit a rule and its quantity, to where its order's document goes."""
    bits = {column: 1 << k for k, column in enumerate(LINE_RULES)}
    rules = sum((F.when(F.expr(rule), bits[column]).otherwise(0) for column, rule in LINE_RULES.items()), F.lit(0))
    lines = (lineitem.where("l_orderkey IS NOT NULL")
             .select(F.col("l_orderkey"), _doc_key("l_orderkey", n_docs).alias("_line_doc"), rules.alias("_rules"), "l_quantity").repartition("_line_doc"))
    shares = [F.avg(F.when(F.col("_rules").bitwiseAND(F.lit(bit)) != 0, 1.0).otherwise(0.0)).alias(column) for column, bit in bits.items()]
    return lines.groupBy("_line_doc", "l_orderkey").agg(*shares, F.sum("l_quantity").alias("enrollment_count"))


def _rows_by_text(spark: SparkSession, tables: dict[str, DataFrame], sizes: dict[str, int] | None = None) -> DataFrame:
    """The rows of ``TRIALS_SQL`` over ``tables``, those with the same document together; ``sizes`` are those of the whole ``DEALT_TABLES``.

    A document stands in many rows. Rows and lines are dealt out by the document's key, which follows from the order
    number, so one shuffle serves the lines' shares and the text, no shuffle or sort carries texts of documents, and equal
    keys lie next to each other. Columns that follow from others, the second copies and the small tables are added behind it.
    """
    sizes = sizes or {name: tables[name].count() for name in DEALT_TABLES}
    n = {name: F.lit(size or None).cast("long") for name, size in sizes.items()}
    key = F.col("o_orderkey")
    rows = tables["orders"].select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    rows = rows.join(tables["customer"].select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey")).drop("c_custkey")
    rows = rows.join(tables["part"].select("p_partkey", "p_brand", "p_type", "p_name"), F.col("p_partkey") == key % n["part"]).drop("p_partkey")
    rows = rows.withColumn("_doc", _doc_key("o_orderkey", sizes["documents"])).repartition("_doc")
    li = _line_shares(tables["lineitem"], sizes["documents"])
    rows = rows.join(li.hint("merge"), (F.col("_doc") == F.col("_line_doc")) & (key == F.col("l_orderkey")), "left")
    rows = rows.join(tables["nation"], F.col("n_nationkey") == F.col("c_nationkey")).join(tables["region"], F.col("r_regionkey") == F.col("n_regionkey"))
    for column, item in (("primary_outcome_text", key % n["benchmark"]), ("exclusion_text", (key * 7 + 3) % n["benchmark"])):
        items = tables["benchmark"].select(F.col("item_id").alias("_item"), F.col("text").alias(column))
        rows = rows.join(items, F.col("_item") == item, "left").drop("_item")
    texts = tables["documents"].select("doc_id", F.col("text").alias("inclusion_text"))
    rows = rows.join(texts.hint("merge"), F.col("doc_id") == F.col("_doc"), "left")
    copies = F.when(key % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    names = {"row_id": "o_orderkey", "sponsor": "c_name", "phases": "o_orderpriority", "funder_type": "c_mktsegment", "study_type": "o_orderstatus", "allocation": "p_brand",
             "intervention_model": "p_type", "primary_purpose": "r_name", "conditions_text": "p_name"}
    rows = rows.withColumn("copy_no", F.explode(copies)).withColumns({
        **{column: F.col(name) for column, name in names.items()},
        "collaborators": F.expr("CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE n_name END"),
        "exclusion_text": F.expr("CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE exclusion_text END"),
        "trial_duration_days": F.expr("CAST(o_custkey % 365 + 30 AS DOUBLE)")})
    return rows.withColumns({column: F.expr(rule) for column, rule in LATE.items()}).select(*spark.sql(TRIALS_SQL).columns)


def _write_view(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write the view in at most SLICES steps, each with all orders of some documents, so that the shuffle files of one step are there at a time."""
    tables = register_tables(spark, sf_dir, TRIAL_TABLES)
    sizes = {name: tables[name].count() for name in DEALT_TABLES}
    slices = max(1, min(SLICES, -(-tables["orders"].count() // SLICE_ORDERS)))
    for i in range(slices):
        # orders, their lines and their documents fall into the same step
        part = {name: df.where(F.pmod(F.xxhash64(_doc_key(SLICE_KEYS[name], sizes["documents"])), F.lit(slices)) == i) if name in SLICE_KEYS else df
                for name, df in tables.items()}
        with shuffles_end_with_jobs(spark), joins_keep_dealt_rows(spark):
            write_trials(_rows_by_text(spark, part, sizes), path, mode="append" if i else "overwrite")
        drop_dead_shuffles(spark)


def trials_view(spark: SparkSession, sf_dir: str, *, materialize: bool = True) -> DataFrame:
    """The raw trial table for ``sf_dir`` (every order, 2% of them twice).

    It plays the role of the input file, so by default it is written once per
    application to the shared checkpoint folder and read back as Parquet:
    later passes (medians, key counts, stats, scoring) then scan a compact
    columnar table with pruning instead of re-running the joins/aggregate,
    and lost executors recompute nothing upstream of it.
    """
    register_tables(spark, sf_dir, TRIAL_TABLES)
    if not materialize:
        return spark.sql(TRIALS_SQL)
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    path = _MATERIALIZED.get(key)
    if path is None:
        tag = hashlib.md5(repr(key).encode()).hexdigest()[:16]
        path = os.path.join(checkpoint_dir(spark), f"trials-{tag}")
        _write_view(spark, sf_dir, path)
        _MATERIALIZED[key] = path
    return spark.read.parquet(path)


def trials_path(spark: SparkSession, sf_dir: str) -> str:
    """Parquet folder of the materialized trial table (written on first use)."""
    trials_view(spark, sf_dir)
    return _MATERIALIZED[(spark.sparkContext.applicationId, os.path.abspath(sf_dir))]
