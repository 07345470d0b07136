"""The fixture as one folder of raw dumps, the way operators deliver them: windows-1251 files whose
first non-ASCII letter comes late, UTF-8 files with a byte-order mark, the same files a second time
under other names, and ZIP archives that also hold a broken member and a spreadsheet. Fields hold
separators, doubled quotes, backslashes and (but for the windows-1251 files) line feeds; some rows
have a field too many or lack the last ones; amounts of one validator are fractional. The number of
files grows with the rows, each file is written by one task as its rows arrive, and nothing passes
through the driver."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farewatch.session import ship_package
from farewatch.sources.fixture import events_raw
from farewatch.sources.raw_files import ZIP_SEPARATOR

BOM = "\ufeff"
LATE_VEHICLE = "Автобус"        # on the taps of the afternoon, which come last in each file
HALF_KOPECK_VALIDATOR = "V4"    # its amounts end in .5
ROWS_PER_FILE = 50_000          # of all rows, for one more file of each kind
CP1251, UTF8 = 0, 1             # kinds of files; 2 and 3 are archives
# fixed values of the mapping: source row modulo -> odd vehicle, odd width
ODD_EVERY, ODD_VEHICLES = 101, ('bus "5"; line, 7', "C:\\", "two\nlines")
LONG_EVERY, LONG_AT = 211, 3
SHORT_EVERY, SHORT_AT, SHORT_FIELDS = 223, 4, 6


def dump_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text rows plus ``_kind``, ``_file`` (its number), ``_late`` and ``_fields`` (how many are
    written; one more than there are columns: a field too many)."""
    r = events_raw(spark, sf_dir)
    files = F.lit(1 + r.count() // ROWS_PER_FILE)
    columns = [c for c in r.columns if not c.startswith("_")]
    hour, row = F.substring(F.col(" date "), 12, 2).cast("int"), F.col("_src_row")
    amount = F.when(F.trim("TRM_ID ") == HALF_KOPECK_VALIDATOR, F.concat("SUMM", F.lit(".5"))).otherwise(F.col("SUMM"))
    kind = (F.col("Card").cast("bigint") % 4).cast("int")
    quoted, path, two_lines = ODD_VEHICLES
    vehicle = F.when(row % ODD_EVERY == 0, quoted).when(row % ODD_EVERY == 1, path) \
        .when((row % ODD_EVERY == 2) & (kind != CP1251), two_lines).when(hour >= 12, F.lit(LATE_VEHICLE))
    fields = F.when(row % LONG_EVERY == LONG_AT, len(columns) + 1).when(row % SHORT_EVERY == SHORT_AT, SHORT_FIELDS).otherwise(len(columns))
    return r.select(kind.alias("_kind"), (F.floor(row / 10) % files).cast("int").alias("_file"), (hour >= 12).cast("int").alias("_late"), "_src_row",
                    fields.alias("_fields"), *[{"VEHICLE": vehicle, "SUMM": amount}.get(c, F.col(f"`{c}`")).alias(c) for c in columns])


class _TextFile:
    """One or more equal text files, written row by row."""

    def __init__(self, fs, paths: list[str], encoding: str, separator: str, header: list[str], bom: str = ""):
        self.stack = ExitStack()
        streams = [self.stack.enter_context(fs.open_output_stream(p)) for p in paths]
        self.buffer = io.StringIO(newline="")
        self.writer = csv.writer(self.buffer, delimiter=separator, lineterminator="\n")
        self.streams, self.encoding = streams, encoding
        self.writer.writerow([bom + header[0], *header[1:]])

    def row(self, fields: list) -> None:
        self.writer.writerow(fields)
        if self.buffer.tell() > 1 << 20:
            self.flush()

    def flush(self) -> None:
        data = self.buffer.getvalue().encode(self.encoding)
        for s in self.streams:
            s.write(data)
        self.buffer.seek(0)
        self.buffer.truncate()

    def close(self) -> None:
        self.flush()
        self.stack.close()


class _Archive(_TextFile):
    """An archive with one table, a spreadsheet and a member whose checksum is wrong."""

    def __init__(self, fs, path: str, header: list[str]):
        self.out = fs.open_output_stream(path)
        self.archive = zipfile.ZipFile(self.out, "w")
        self.member = self.archive.open("taps.csv", "w", force_zip64=True)
        super().__init__(fs, [], "utf-8", ZIP_SEPARATOR, header)
        self.streams = [self.member]

    def close(self) -> None:
        super().close()
        self.member.close()
        self.archive.writestr("reports/summary.xlsx", b"not a table")
        self.archive.writestr("damaged.csv", "DATE;CARD\n" + "x" * 64)
        self.archive.getinfo("damaged.csv").CRC ^= 1          # what the directory will say
        self.archive.close()
        self.out.close()


def _writer(columns: list[str], folder: str):
    """Each task streams its rows, in order of files, into the file of their kind and number."""
    def open_file(fs, root, kind, number):
        if kind == CP1251:
            return _TextFile(fs, [f"{root}/cp1251/part{number}.csv"], "cp1251", ";", columns)
        if kind == UTF8:
            return _TextFile(fs, [f"{root}/{d}/part{number}.csv" for d in ("utf8", "utf8_again")], "utf-8", ",", columns, BOM)
        return _Archive(fs, f"{root}/zip/bundle{kind}-{number}.zip", columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        for d in ("cp1251", "utf8", "utf8_again", "zip"):
            fs.create_dir(f"{root}/{d}", recursive=True)
        out = key = None
        for pdf in batches:
            for kind, number, fields, *values in pdf.itertuples(index=False):
                if (kind, number) != key:
                    if out:
                        out.close()
                    key, out = (kind, number), open_file(fs, root, kind, number)
                out.row([*("" if v is None else v for v in values), "x"][:fields])
        if out:
            out.close()
        yield pd.DataFrame({"number": pd.Series([], dtype="int32")})
    return run


def write_dump(spark: SparkSession, sf_dir: str, root: str) -> str:
    """Write the dump under ``root``; returns the path pattern that lists its files."""
    ship_package(spark)
    rows = dump_rows(spark, sf_dir)
    columns = [c for c in rows.columns if not c.startswith("_")]
    ordered = rows.repartition("_kind", "_file").sortWithinPartitions("_kind", "_file", "_late", "_src_row")
    written = ordered.select("_kind", "_file", "_fields", *[F.col(f"`{c}`") for c in columns]).mapInPandas(_writer(columns, root), "number int")
    written.write.format("noop").mode("overwrite").save()
    return f"{root}/*"
