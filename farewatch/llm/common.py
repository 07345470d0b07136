"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farewatch.session import ensure_checkpoint_dir, ship_package

# fixed values: the word classes of the query contracts (ASCII white space only, everything
# else belongs to a word; and letters, digits and every non-ASCII character after lower-casing)
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LOWER_ASCII = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder; the package is shipped to the executors on the way."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared checkpoint folder (never a machine-local one on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/farewatch-llm/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back: cuts the lineage, so a lost
    executor never re-runs what lies above and several readers share one computation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_bucket(doc_id, modulus: int):
    """crc32 of the id written as text, modulo ``modulus`` (Column); null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def crc32_text(value) -> int:
    return zlib.crc32(str(value).encode())


def map_rows(batches: Iterable[pa.RecordBatch], schema: pa.Schema, fn) -> Iterator[pa.RecordBatch]:
    """Apply ``fn(ids, texts) -> dict of columns`` to each Arrow batch of (doc_id, text)."""
    for b in batches:
        if b.num_rows:
            out = fn(b.column(0), b.column(1).to_pylist())
            yield pa.RecordBatch.from_pydict(out, schema=schema)


def id_text(docs: DataFrame) -> DataFrame:
    """Just (doc_id as long, text as string); other columns never reach the operators."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def filter_rows(docs: DataFrame, keep) -> DataFrame:
    """Rows of ``docs``, all columns as they are, where ``keep(texts)`` (an Arrow array of the text
    column to a boolean array) says so; one pass without a shuffle."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(keep(b.column(at).cast(pa.string())), pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
