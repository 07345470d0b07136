"""Mixing sources to target weights by systematic sampling.

Every source gets a target (its weight's share of the wanted total, at most ``cap`` times its
own size, the excess shared again by weight). A document's expected copies are its source's
target / size. Within a source the expected copies are prefix-summed over the documents ordered
by size, one random offset per source is added, and a document is emitted once per integer
boundary its interval crosses. Ordering by size keeps the taken words within about one document
of the target (the interval error is below one copy at every size).

The prefix sum is distributed: documents are range-partitioned by (source, size, hash, id), so a
source with a third of all rows spreads over many tasks; each partition contributes one count
per source, and those counts (partitions + sources rows) are summed up to offsets.

Defined results: null text has size 0; a null source is a source of its own, last in order;
sources of size 0 take nothing; an empty table gives an empty table; repeated rows are separate
documents; a null doc_id is an id like any other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, materialise, read_table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    The level L with sum(min(weight * L, cap * size)) = share * total is found by sorting the
    sources by cap * size / weight: the first ones are full, the rest share what remains. The
    windows run over one row per source."""
    by = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
          .withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    by = by.withColumn("_w", w).withColumn("_full", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("_full") / F.col("_w"), "_rank")
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    by = (by.withColumn("_total", F.sum("source_size").over(everyone) * F.lit(float(share)))
          .withColumn("_before", F.sum("_full").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
                      - F.col("_full"))
          .withColumn("_level", (F.col("_total") - F.col("_before")) / F.sum("_w").over(after))
          .withColumn("_open", F.col("_w") * F.col("_level") <= F.col("_full")))
    level = F.min(F.when(F.col("_open"), F.struct(F.col("_full") / F.col("_w"), F.col("_rank"), F.col("_level")))).over(everyone)
    by = by.withColumn("_at", level)
    target = F.when(F.col("_at").isNull(), F.col("_full")).otherwise(
        F.least(F.col("_full"), F.col("_w") * F.col("_at")["_level"]))
    return by.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP,
        seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, copies) for every row of ``docs``."""
    sized = materialise(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"),
        F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12)
        .alias("_h")), "mix-sizes")
    targets = materialise(source_targets(sized, weights, share, cap), "mix-targets")
    ordered = materialise(
        sized.repartitionByRange(F.col("source").asc_nulls_last(), "size", "_h", "doc_id")
        .sortWithinPartitions(F.col("source").asc_nulls_last(), "size", "_h", "doc_id")
        .select("doc_id", "source", "size", F.spark_partition_id().alias("_part"),
                F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")), "mix-ordered")
    runs = ordered.groupBy("source", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.withColumn("_start", F.sum("_n").over(before) - F.col("_n") - F.col("_first"))
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    r = runs.select(F.col("source").alias("_s"), "_part", "_start")
    per_run = r.join(t, r["_s"].eqNullSafe(t["_s"])).select(r["_s"], "_part", "_start", "source_size", "target")
    out = ordered.join(per_run.withColumnRenamed("_part", "_p"), (F.col("_part") == F.col("_p"))
                       & F.col("source").eqNullSafe(F.col("_s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    unit = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("offset"), F.coalesce("source", F.lit("")))), 1, 12), 16, 10)
    offset = unit.cast("double") / F.lit(float(16 ** 12))
    k = (F.col("_start") + F.col("_row") + 1).cast("double")
    copies = F.floor(offset + k * rate) - F.floor(offset + (k - 1) * rate)
    return out.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"))


def emit(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` repeated by the copies that ``mixed`` gives their doc_id, all columns.
    Rows of a repeated id share the id's copies evenly, the first ones taking what is over."""
    per_id = materialise(mixed.groupBy("doc_id").agg(F.sum("copies").alias("_fw_copies"), F.count(F.lit(1)).alias("_fw_rows"))
                         .where("_fw_copies > 0").withColumnRenamed("doc_id", "_fw_id"), "mix-copies")
    cols = [F.col(f"d.`{c}`") for c in docs.columns]
    # one row per document: never broadcast, at any size
    once, often = (docs.alias("d").join(per_id.where(cond).hint("merge"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("_fw_id")))
                   for cond in ("_fw_rows = 1", "_fw_rows > 1"))
    place = F.row_number().over(Window.partitionBy("_fw_id").orderBy(F.xxhash64("d.text")))
    share = F.floor(F.col("_fw_copies") / F.col("_fw_rows")) + F.when(place <= F.col("_fw_copies") % F.col("_fw_rows"), 1).otherwise(0)
    rows = (once.select(*cols, F.col("_fw_copies").cast("int").alias("_fw_n"))
            .unionByName(often.select(*cols, share.cast("int").alias("_fw_n")).where("_fw_n > 0")))
    return rows.withColumn("_fw_n", F.explode(F.sequence(F.lit(1), F.col("_fw_n")))).drop("_fw_n")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(read_table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS h
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk
  FROM s GROUP BY source),
w AS (
  SELECT *, CASE rk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS wt,
         source_size * 2.0::DOUBLE AS full_ FROM src),
c AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
         sum(full_) OVER (ORDER BY full_ / wt, rk) - full_ AS before_,
         sum(wt) OVER (ORDER BY full_ / wt, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wrest
  FROM w),
l AS (SELECT *, (total - before_) / wrest AS lev FROM c),
lv AS (SELECT arg_min(lev, rn) AS lev FROM (
  SELECT lev, row_number() OVER (ORDER BY full_ / wt, rk) AS rn FROM l WHERE wt * lev <= full_)),
t AS (SELECT source, source_size,
             CASE WHEN (SELECT lev FROM lv) IS NULL THEN full_ ELSE least(full_, wt * (SELECT lev FROM lv)) END AS target
      FROM l),
r AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST(row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.h, s.doc_id NULLS FIRST) AS DOUBLE) AS k,
         CAST(CAST('0x' || substr(md5('mix-1|offset|' || coalesce(s.source, '')), 1, 12) AS BIGINT) AS DOUBLE)
           / 281474976710656.0::DOUBLE AS off
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(floor(off + k * rate) - floor(off + (k - 1) * rate) AS BIGINT) * size AS taken,
       CAST(floor(off + k * rate) - floor(off + (k - 1) * rate) AS BIGINT) AS copies
FROM r
"""
