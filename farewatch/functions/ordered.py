"""Order-dependent building blocks that stay balanced when one key is hot.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. When one card or
terminal holds a third of the data that task does a third of the work. The helpers here find the
keys that would fill half of an average task or more (one narrow pass with a frequent-items sketch)
and split only their timelines into fixed time buckets ``(key, bucket)``; a small per-bucket
summary (one row per non-empty bucket of a hot key) carries state across bucket borders, and only
the rows at those borders are joined with it. Without hot keys there is one shuffle and nothing is
written; with them every row is still shuffled once. Whether a key counts as hot never changes a
result. Rank-type questions over few large groups use range partitioning with per-partition offsets,
so no group is sorted by a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farewatch.functions.time import epoch_seconds
from farewatch.session import scratch_folder

DEFAULT_BUCKET_SECONDS = 3600  # busy keys (validators): hour buckets
SPARSE_BUCKET_SECONDS = 86400  # sparse keys (cards): day buckets keep the carry table small


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, for frames that several branches
    of a plan read. This runs the job that computes it."""
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bucket(ts: str, bucket_seconds: int) -> Column:
    return F.floor(epoch_seconds(ts) / bucket_seconds)


def hot_keys(df: DataFrame, keys: Sequence[str], parts: int | None = None) -> list[int]:
    """Hashes of the keys that hold so many rows that they would fill half of an average shuffle
    partition (of ``parts``, or as many as the session sets): at most twice as many as there are
    partitions. One aggregation over the key columns; its sketch tracks sixteen times as many
    keys, so none of that share escapes it."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(2 * parts, 50_000)
    found = df.select(F.xxhash64(*keys).alias("_k")).agg(
        F.expr(f"approx_top_k(_k, {most}, {min(max(16 * most, 1024), 1_000_000)})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [r["item"] for r in found["top"] or [] if r["item"] is not None and r["count"] * 2 * parts >= found["n"] and r["count"] > 1]


def _split(df: DataFrame, keys: list[str], ts: str, bucket_seconds: int) -> DataFrame | None:
    """``df`` with ``_b``, the time bucket of hot keys' rows (null for all others); None if no key is hot."""
    hot = hot_keys(df, keys)
    if not hot:
        return None
    return df.withColumn("_b", F.when(F.xxhash64(*keys).isin(hot), _bucket(ts, bucket_seconds)))


def _join_carry(edge: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Rows at the borders of hot keys' buckets with their bucket's ``_carry``."""
    c = carry.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate((*keys, "_b"))], "_carry")
    cond = [edge[k].eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate((*keys, "_b"))]
    return edge.join(c, cond, "left").drop(*[f"_k{n}" for n in range(len(keys) + 1)])


def with_previous(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str],
                  cols: Sequence[str], prefix: str = "prev_",
                  bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Add ``prev_<c>`` for ``ts`` and each of ``cols``: the values of the preceding row of the
    same key in ``(ts, *tiebreak)`` order (null for a key's first row). Equivalent to
    ``lag(c) over (partition by keys order by ts, tiebreak)``.

    Rows are shuffled once, for the window over the key (and the bucket, if the key is hot). With
    hot keys that frame is written; the first row of each of their buckets gets the last row of the
    bucket before, and only those rows are joined."""
    keys, order = list(keys), [ts, *tiebreak]
    carried = [ts, *[c for c in cols if c != ts]]
    payload = F.struct(*[F.col(c).alias(c) for c in carried])
    split = _split(df, keys, ts, bucket_seconds)

    def out(frame: DataFrame, prev: Column) -> DataFrame:
        return frame.select(*df.columns, *[prev[c].alias(prefix + c) for c in carried])
    if split is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return out(df.withColumn("_prev", F.lag(payload).over(w)), F.col("_prev"))
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    border = F.col("_b").isNotNull()
    inner = written(split.withColumn("_p", payload).withColumn("_prev", F.lag("_p").over(w))
                    .withColumn("_end", border & F.lead(F.lit(False), 1, True).over(w))
                    .withColumn("_edge", border & F.col("_prev").isNull()), "previous")
    last = inner.where("_end").select(*keys, "_b", F.col("_p").alias("_last")) \
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")))
    edge = _join_carry(inner.where("_edge"), last, keys)
    return out(inner.where("not _edge"), F.col("_prev")).unionByName(out(edge, F.col("_carry")))


def carry_forward_last(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str],
                       cond: Column, value: Column, name: str,
                       bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Add ``name`` = ``value`` of the latest row at or before each row (same key,
    ``(ts, *tiebreak)`` order) for which ``cond`` holds; null if there is none. This is the
    gaps-and-islands "session start"; for hot keys without a running window over a whole key:
    only their rows before a bucket's first such row are joined with what earlier buckets carry."""
    keys, order = list(keys), [ts, *tiebreak]
    mark = F.when(cond, F.struct(F.struct(*order).alias("_o"), value.alias("_v")))
    split = _split(df, keys, ts, bucket_seconds)

    def out(frame: DataFrame, last: Column) -> DataFrame:
        return frame.select(*df.columns, last["_v"].alias(name))
    if split is None:
        running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return out(df.withColumn("_m", mark).withColumn("_in", F.max("_m").over(running)), F.col("_in"))
    running = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = written(split.withColumn("_m", mark).withColumn("_in", F.max("_m").over(running))
                    .withColumn("_edge", F.col("_b").isNotNull() & F.col("_in").isNull()), "carried")
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = inner.where("_b is not null").groupBy(*keys, "_b").agg(F.max("_m").alias("_bm")) \
        .withColumn("_carry", F.max("_bm").over(earlier))
    edge = _join_carry(inner.where("_edge"), per_bucket, keys)
    return out(inner.where("not _edge"), F.col("_in")).unionByName(out(edge, F.col("_carry")))


def first_k(df: DataFrame, group_cols: Sequence[str], value_col: str, order_cols: Sequence[str],
            k: int, name: str, distinct: bool = True) -> DataFrame:
    """One row per group with an array of the first ``k`` values in ``order_cols`` order
    (first appearances when ``distinct``). ``row_number() <= k`` plans as a WindowGroupLimit,
    so at most ``k`` rows per group travel; nothing collects a whole group."""
    group_cols = list(group_cols)
    if distinct:
        base = df.groupBy(*group_cols, value_col).agg(F.min(F.struct(*order_cols)).alias("_o"))
    else:
        base = df.select(*group_cols, value_col, F.struct(*order_cols).alias("_o"))
    w = Window.partitionBy(*group_cols).orderBy("_o", value_col)
    top = base.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("_rn", value_col)))
    return top.groupBy(*group_cols).agg(F.transform(ordered, lambda x: x[value_col]).alias(name))


def exclusive_prefix_sum(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column | str],
                         weight: str, name: str, partitions: int | None = None) -> DataFrame:
    """Add ``name`` = sum of ``weight`` over rows of the same group that come strictly before
    each row in ascending ``order_cols`` order (a total order inside a group).

    Rows are range-partitioned on ``(group, order)`` by Spark, so a large group spans many tasks,
    and written once with their partition's number: later branches and retries all see the same
    partitions. Each (partition, group) slice computes local sums; slice totals (at most
    partitions + groups rows) give the offsets. The write happens when this is called."""
    group_cols = list(group_cols)
    order = {f"_o{k}": F.col(c) if isinstance(c, str) else c for k, c in enumerate(order_cols)}
    keyed = df.withColumns(order)
    keys = [*group_cols, *order]
    ranged = keyed.repartitionByRange(partitions, *keys) if partitions else keyed.repartitionByRange(*keys)
    ranged = written(ranged.sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id()), "ranged")
    slice_order = Window.partitionBy("_pid", *group_cols).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(weight).over(slice_order), F.lit(0)))
    totals = ranged.groupBy("_pid", *group_cols).agg(F.sum(weight).alias("_ptot"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_ptot").over(before), F.lit(0))) \
        .select("_pid", *group_cols, "_off")
    out = local.join(offsets, ["_pid", *group_cols], "left")
    return out.select(*df.columns, (F.col("_off") + F.col("_local")).alias(name))
