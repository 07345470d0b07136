"""One CSV file in the order of a frame, for people who open it in a spreadsheet.

The frame is written as parts by its own tasks, in its order, to the shared folder; one task then
streams the parts, one after the other and in chunks, behind a byte-order mark and the header. So the
rows are sorted and formatted in parallel and no process holds them."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from farewatch.session import scratch_folder, ship_package

BOM = "﻿"
CHUNK_BYTES = 4 << 20


def _file_system(path: str):
    import pyarrow.fs as pafs

    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _part_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the written parts in the frame's order (metadata: one per partition)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(n for n in (f.getPath().getName() for f in listed) if n.startswith("part-"))


def write_one_csv(df: DataFrame, path: str) -> None:
    """Write ``df`` to the one file ``path``: mark, header, rows in the frame's order; fields that
    hold separators, quotes or line ends are quoted, quotes doubled; missing values are empty."""
    spark = df.sparkSession
    ship_package(spark)
    folder = scratch_folder(spark, "export")
    df.write.option("escape", '"').option("emptyValue", "").csv(folder)
    names = _part_names(spark, folder)
    header = io.StringIO(newline="")
    csv.writer(header, lineterminator="\n").writerow(df.columns)
    head = (BOM + header.getvalue()).encode()

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            fs, target = _file_system(path)
            source, root = _file_system(folder)
            fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(target) as out:
                out.write(head)
                for name in names:
                    with source.open_input_stream(f"{root}/{name}") as part:
                        while chunk := part.read(CHUNK_BYTES):
                            out.write(chunk)
        yield pd.DataFrame({"id": pd.Series([], dtype="int64")})
    spark.range(0, 1, 1, 1).mapInPandas(join, "id long").write.format("noop").mode("overwrite").save()
