"""Base and intermediate tables every query starts from, written once per session and folder.

``tx_norm`` is the normalised (not de-duplicated) table: it feeds H20r and the card features.
``tx`` is the de-duplicated table all rules read; ``anomalies``, ``report``, ``labels`` and
``features`` are the later stages. Each is written as Parquet under the cluster's shared
``spark.checkpoint.dir`` and read back: downstream plans start from a file scan (short lineage,
predicate pushdown, column pruning) and a lost executor never forces a recompute upstream."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from farewatch.operators.dedupe import remove_near_duplicates
from farewatch.session import ensure_checkpoint_dir, prepare
from farewatch.sources.fixture import events_raw, events_tx

_CACHE: dict[tuple, DataFrame] = {}


def materialize(spark: SparkSession, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and return a scan of it."""
    root = ensure_checkpoint_dir(spark)
    path = os.path.join(root, "farewatch", spark.sparkContext.applicationId, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)


def shared(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    sf = sf_dir.rstrip("/")
    key = (id(spark), spark.sparkContext.applicationId, sf, name)
    df = _CACHE.get(key)
    if df is None:
        prepare(spark)
        tag = hashlib.sha1(sf.encode()).hexdigest()[:10]
        # a fresh folder per materialisation: never overwrite files another frame may read
        df = materialize(spark, build(), f"{tag}/{name}-{uuid.uuid4().hex[:8]}")
        _CACHE[key] = df
    return df


def tx_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "tx_norm", lambda: events_tx(spark, sf_dir))


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "tx", lambda: remove_near_duplicates(tx_norm(spark, sf_dir)))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw text rows, written like every stage: the mapping that makes them and the
    normalisation that reads them would not fit one generated method together."""
    return shared(spark, sf_dir, "raw", lambda: events_raw(spark, sf_dir))


def clear() -> None:
    _CACHE.clear()
