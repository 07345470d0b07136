"""Raw transaction dumps: folders of delimited text files and ZIP archives of them.

* ``examine_files``: one task per file streams the whole file in chunks and reports its SHA-1,
  whether all of it is valid UTF-8, its byte-order mark, its header line, and how its quotes must be
  read. Nothing is decided from a prefix, no file is held in memory, and the driver sees one row per
  file.
* ``list_input_files``: supported files (dot files are hidden), one path per distinct content, first
  path in sorted order. Files whose name begins with an underscore, which the engine cannot read,
  are rejected by name.
* CSV: files with the same (separator, charset, header, quoting) are read by one ``spark.read.csv``
  with an explicit all-string schema and doubled quotes. Where no quoted field holds a line end, lines
  are records and large files are split; files with such fields are read whole, one task each; files
  with text after a closing quote or carriage returns in quoted fields, which the engine's parser
  reads otherwise, are streamed through a CSV parser like archive members. windows-1251 files are read as ISO-8859-1, which maps every byte to
  one character, and translated column by column, so no session setting is needed.
* ZIP: archive directories are listed first, then every (archive, member) pair is streamed through
  a CSV parser in its own task, in bounded batches.

What cannot be read, or not as it stands, lands in a reject table (archive: the file, member, row,
error, text). Rows with more fields than the header are rejected; rows with fewer are read, the rest
missing, and noted. Files with a quote that never closes, members and archives that cannot be read,
and spreadsheet members are rejected. An archive that yields nothing is an error.

Every row carries ``_src_file`` (path, for split files with the zero-padded split offset) and
``_src_row`` (row inside it), whose order is the input order.
"""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
import zipfile
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farewatch.session import scratch_folder, ship_package

# fixed values: accepted suffixes, separators and charsets in the order they are tried
CSV_SUFFIXES = (".csv",)
ZIP_SUFFIXES = (".zip",)
UNSUPPORTED_SUFFIXES = (".xlsx", ".xls", ".xltx", ".cell")
MEMBER_SPREADSHEETS = (".xlsx", ".xls")
SEPARATORS = (";", ",", "\t", "|")
ZIP_SEPARATOR = ";"
CHUNK_BYTES = 4 << 20
BATCH_ROWS = 20_000
MAX_HEADER_BYTES = 1 << 20   # a "header" beyond this is no delimited file
MAX_FIELD_CHARS = 64 << 20   # a longer quoted field is a quote that never closes
LINES, SPANS, LOOSE = "lines", "spans", "loose"
UNCLOSED = "file: a quote never closes"
HIDDEN = "file: the engine does not read names that begin with _"
_SENTINEL = "end of file"
_CORRUPT = "_corrupt_row"
REJECTS = "archive string, member string, row long, error string, text string"

# windows-1251 above ASCII, as the characters ISO-8859-1 gives for the same bytes
_LATIN_HIGH = "".join(map(chr, range(128, 256)))
_CP1251_HIGH = bytes(range(128, 256)).decode("cp1251", errors="replace")


def _open(path: str):
    """Random-access file handle for a Spark path (local, HDFS, S3, ...) inside a task."""
    from urllib.parse import unquote, urlparse

    import pyarrow.fs as pafs

    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file(unquote(urlparse(path).path))
    fs, rel = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(rel)


def examine(stream) -> tuple[str, str, bytes, bool]:
    """(SHA-1, charset, header line bytes, whether there is a quote) of a byte stream, read to its
    end in chunks."""
    digest, decoder = hashlib.sha1(), codecs.getincrementaldecoder("utf-8")()
    utf8, header, done, quotes = True, b"", False, False
    while chunk := stream.read(CHUNK_BYTES):
        digest.update(chunk)
        quotes = quotes or b'"' in chunk
        if utf8:
            try:
                decoder.decode(chunk)
            except UnicodeDecodeError:
                utf8 = False
        if not done:
            header += chunk
            line = header.split(b"\n", 1)
            done = len(line) > 1 or len(header) > MAX_HEADER_BYTES
            header = line[0]
    if utf8:
        try:
            decoder.decode(b"", True)
        except UnicodeDecodeError:
            utf8 = False
    return digest.hexdigest(), "UTF-8" if utf8 else "windows-1251", header, quotes


def quoting(open_stream, header: bytes) -> str:
    """How a file that holds quotes must be read: ``lines`` (a record is a line), ``spans`` (quoted
    fields hold line feeds), ``loose`` (they hold carriage returns, which the engine's parser changes,
    or text follows a closing quote, which it leaves quoted), or the reason why it cannot be.
    Quotes count where a field begins, so the file is run through a CSV parser, record by record."""
    sep = _separator(header.decode("latin-1"))
    if sep is None:
        return LINES

    def records(strict):
        with open_stream() as fh:
            parser = csv.reader(chain(io.TextIOWrapper(fh, "latin-1", newline=""), [_SENTINEL]), delimiter=sep, strict=strict)
            before, how, last = 0, LINES, []
            for last in parser:  # noqa: B007 - the last record is looked at
                if parser.line_num > before + 1 and how != LOOSE:
                    how = LOOSE if any("\r" in field for field in last) else SPANS
                before = parser.line_num
            return how, last == [_SENTINEL]
    before = csv.field_size_limit(MAX_FIELD_CHARS)
    try:
        try:
            how, ended = records(True)
        except csv.Error as exc:
            if "expected after" not in str(exc):
                raise
            how, ended = LOOSE, records(False)[1]
        return how if ended else UNCLOSED
    except csv.Error as exc:
        return UNCLOSED if "unexpected end" in str(exc) or "field larger" in str(exc) else f"file: {exc}"
    finally:
        csv.field_size_limit(before)


def _separator(header: str) -> str | None:
    return next((sep for sep in SEPARATORS if len(next(csv.reader([header], delimiter=sep), [])) > 1), None)


def layout(charset: str, header: bytes) -> tuple[str, list[str]]:
    """(separator, trimmed upper-case column names) of a header line."""
    text = header.decode("utf-8-sig" if charset == "UTF-8" else "cp1251", errors="replace").rstrip("\r")
    sep = _separator(text)
    if sep is None:
        raise ValueError("cannot find a separator in the header line")
    return sep, [n.strip().upper() for n in next(csv.reader([text], delimiter=sep))]


def _examine_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path in pdf["path"]:
            with _open(path) as fh:
                sha, charset, header, quotes = examine(fh)
            how = quoting(lambda path=path: _open(path), header) if quotes and path.lower().endswith(CSV_SUFFIXES) else LINES
            yield pd.DataFrame([(path, sha, charset, header, how)], columns=["path", "sha1", "charset", "header", "quoting"])


def _suffix(name: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(name).endswith(s) for s in CSV_SUFFIXES + ZIP_SUFFIXES + UNSUPPORTED_SUFFIXES])


def examine_files(spark: SparkSession, data_dir: str) -> DataFrame:
    """(path, sha1, charset, header, quoting) of the supported files, first path of each content only."""
    ship_package(spark)
    # the file listing is metadata: the binaryFile scan prunes the content column
    listing = spark.read.format("binaryFile").load(data_dir).select("path").filter(_suffix(F.col("path")))
    found = listing.repartition("path").mapInPandas(_examine_paths, "path string, sha1 string, charset string, header binary, quoting string")
    return found.groupBy("sha1").agg(F.min_by(F.struct("path", "charset", "header", "quoting"), "path").alias("f")) \
        .select("f.path", "sha1", "f.charset", "f.header", "f.quoting")


def hidden_files(spark: SparkSession, data_dir: str) -> list[str]:
    """Supported files of the folder(s) that the engine's own listing leaves out (names with _)."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(data_dir)
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for top in fs.globStatus(pattern) or []:
        for f in fs.listStatus(top.getPath()) if top.isDirectory() else [top]:
            name = f.getPath().getName()
            if f.isFile() and name.startswith("_") and name.lower().endswith(CSV_SUFFIXES + ZIP_SUFFIXES + UNSUPPORTED_SUFFIXES):
                out.append(f.getPath().toString())
    return sorted(out)


def list_input_files(spark: SparkSession, data_dir: str) -> list[str]:
    """Supported files of ``data_dir`` with duplicate contents removed (first sorted path kept)."""
    return [r["path"] for r in _files(spark, data_dir)]


def _files(spark: SparkSession, data_dir: str) -> list:
    files = sorted(examine_files(spark, data_dir).collect(), key=lambda r: r["path"])  # one row per file
    if not files:
        raise FileNotFoundError(f"no supported files in {data_dir}")
    return files


def _lineage(df: DataFrame) -> DataFrame:
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # splits of a file keep their order through the offset, whatever its size
    name = F.concat(F.col("_metadata.file_path"), F.lit("#"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 19, "0"))
    return df.withColumn("_src_file", name).withColumn("_src_row", row)


def _from_cp1251(c: Column) -> Column:
    return F.translate(c, _LATIN_HIGH, _CP1251_HIGH)


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = defaultdict(int)
    out = []
    for n in names:
        out.append(n if not seen[n] else f"{n}.{seen[n]}")
        seen[n] += 1
    return out


def _fields(text: Column, sep: str) -> Column:
    """Number of fields of a record; separators inside quoted fields do not count."""
    s = "\\" + sep if sep in "|" else sep
    bare = F.regexp_replace(text, rf'(?<=^|{s})"[^"]*+(?:""[^"]*+)*+"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def _width_error(fields: Column, columns: Column | int) -> Column:
    n = F.lit(columns) if isinstance(columns, int) else columns
    return F.when(fields > n, F.format_string("row: %d fields, the header has %d", fields, n)) \
        .when(fields < n, F.format_string("row: %d of %d fields, the rest is missing", fields, n))


def read_csv_files(spark: SparkSession, files: list) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of examined CSV files (path, charset, header, quoting), grouped by layout."""
    groups: dict[tuple, list[str]] = defaultdict(list)
    frames, rejects = [], [spark.createDataFrame([], REJECTS)]
    loose = []
    for f in files:
        if f["quoting"] not in (LINES, SPANS, LOOSE):
            rejects.append(spark.createDataFrame([(f["path"], "", None, f["quoting"], None)], REJECTS))
            continue
        sep, header = layout(f["charset"], bytes(f["header"]))
        if f["quoting"] == LOOSE:
            loose.append((f["path"], sep, f["charset"]))
        else:
            groups[(sep, f["charset"], tuple(header), f["quoting"])].append(f["path"])
    for (sep, charset, header, how), paths in groups.items():
        names = _unique(list(header))
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, _CORRUPT)])
        encoding = "UTF-8" if charset == "UTF-8" else "ISO-8859-1"
        # without column pruning, so that the width of a row is always checked
        df = _lineage(spark.read.option("columnPruning", "false").csv(
            paths, schema=schema, header=True, sep=sep, encoding=encoding, mode="PERMISSIVE", enforceSchema=True, quote='"', escape='"',
            multiLine=how == SPANS, columnNameOfCorruptRecord=_CORRUPT))
        if charset != "UTF-8":
            df = df.select(*[_from_cp1251(F.col(f"`{n}`")).alias(n) for n in (*names, _CORRUPT)], "_src_file", "_src_row")
        fields = F.when(F.col(_CORRUPT).isNotNull(), _fields(F.col(_CORRUPT), sep))
        # the engine wants more than the corrupt record to be looked at; the first column always is
        looked = F.coalesce(F.length(F.col(f"`{names[0]}`")), F.lit(0)) >= 0
        blank = (fields == 1) & (F.trim(_CORRUPT) == "")                 # white space only: no record
        kept = df.filter(looked & (fields.isNull() | ((fields <= len(names)) & ~blank)))
        frames.append(kept.drop(_CORRUPT))
        odd = df.filter(looked & (fields != len(names)) & ~blank)
        rejects.append(odd.select(F.col("_src_file").alias("archive"), F.lit("").alias("member"), F.col("_src_row").alias("row"),
                                  _width_error(fields, len(names)).alias("error"), F.col(_CORRUPT).alias("text")))
    if loose:
        listed = spark.createDataFrame(loose, "archive string, separator string, charset string").repartition("archive")
        folder = scratch_folder(spark, "loose")
        listed.mapInPandas(_loose_rows, ZIP_ROW_SCHEMA).write.parquet(folder)
        rows, bad = _parsed(spark.read.schema(ZIP_ROW_SCHEMA).parquet(folder))
        frames += rows
        rejects.append(bad)
    if not frames:
        return spark.createDataFrame([], "_src_file string, _src_row long"), reduce(DataFrame.unionByName, rejects)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), reduce(DataFrame.unionByName, rejects)


def _visible(name: str) -> bool:
    return "__MACOSX" not in name and not name.rsplit("/", 1)[-1].startswith(".")


def _zip_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(archive, member, error) from each archive's central directory only."""
    for pdf in batches:
        out = []
        for path in pdf["path"]:
            try:
                with _open(path) as fh, zipfile.ZipFile(fh) as archive:
                    names = [n for n in archive.namelist() if _visible(n)]
                out.extend((path, n, None) for n in names if n.lower().endswith(CSV_SUFFIXES))
                out.extend((path, n, "member: spreadsheets are not read") for n in names if n.lower().endswith(MEMBER_SPREADSHEETS))
            except Exception as exc:  # noqa: BLE001 - a broken archive is a reject, not a crash
                out.append((path, "", f"archive: {exc}"))
        yield pd.DataFrame(out, columns=["archive", "member", "error"])


ZIP_ROW_COLUMNS = ["archive", "member", "row_no", "header", "fields", "error"]
ZIP_ROW_SCHEMA = "archive string, member string, row_no long, header array<string>, fields array<string>, error string"


def _stream(archive: str, member: str, parser) -> Iterator[pd.DataFrame]:
    """A parser's rows in batches; after a break the rows before it and a reject."""
    rows: list[tuple] = []
    try:
        header = next(parser, None)
        for k, fields in enumerate(parser):
            if fields and (len(fields) > 1 or fields[0].strip()):
                rows.append((archive, member, k, header, fields, None))
            if len(rows) >= BATCH_ROWS:
                yield pd.DataFrame(rows, columns=ZIP_ROW_COLUMNS)
                rows = []
    except Exception as exc:  # noqa: BLE001
        rows.append((archive, member, -1, None, None, f"member: {exc}"))
    if rows:
        yield pd.DataFrame(rows, columns=ZIP_ROW_COLUMNS)


def _member_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parsed rows of archive members, streamed: a member never stands in memory as a whole. A
    member that breaks half-way keeps the rows before the break and adds a reject."""
    for pdf in batches:
        for path, name in zip(pdf["archive"], pdf["member"], strict=True):
            try:
                with _open(path) as fh, zipfile.ZipFile(fh) as archive, archive.open(name) as member:
                    text = io.TextIOWrapper(member, encoding="utf-8-sig", errors="replace", newline="")
                    yield from _stream(path, name, csv.reader(text, delimiter=ZIP_SEPARATOR))
            except Exception as exc:  # noqa: BLE001
                yield pd.DataFrame([(path, name, -1, None, None, f"member: {exc}")], columns=ZIP_ROW_COLUMNS)


def _loose_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parsed rows of text files with text after closing quotes, streamed alike."""
    for pdf in batches:
        for path, sep, charset in pdf.itertuples(index=False):
            with _open(path) as fh:
                text = io.TextIOWrapper(fh, encoding="utf-8-sig" if charset == "UTF-8" else "cp1251", errors="replace", newline="")
                yield from _stream(path, "", csv.reader(text, delimiter=sep))


def _parsed(parsed: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(one frame of rows per header, rejects) of parsed rows."""
    width, fields = F.size("header"), F.size("fields")
    good = parsed.filter(F.col("error").isNull())
    wide = good.filter(fields != width).select("archive", "member", F.col("row_no").alias("row"), _width_error(fields, width).alias("error"),
                                               F.concat_ws(ZIP_SEPARATOR, "fields").alias("text"))
    broken = parsed.filter(F.col("error").isNotNull()).select("archive", "member", F.lit(None).cast("long").alias("row"), "error",
                                                              F.lit(None).cast("string").alias("text"))
    rows, frames = good.filter(fields <= width), []
    for r in rows.select("header").distinct().collect():                      # one row per layout
        names = _unique([n.strip().upper() for n in r["header"]])
        own = rows.filter(F.col("header") == F.array(*map(F.lit, r["header"])))
        # an empty field is a missing value, as in the CSV reader
        values = [F.get("fields", F.lit(k)) for k in range(len(names))]
        frames.append(own.select(*[F.when(v != "", v).alias(n) for v, n in zip(values, names, strict=True)],
                                 F.when(F.col("member") == "", F.col("archive")).otherwise(F.concat_ws("!", "archive", "member")).alias("_src_file"),
                                 F.col("row_no").alias("_src_row")))
    return frames, wide.unionByName(broken)


def read_zip_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of the archives.

    The directories are read first; then the (archive, member) pairs are spread over tasks, so an
    archive with a large share of the data is decompressed by many tasks. The parsed rows are
    written once to the shared folder, because headers, rows and rejects all come from them."""
    ship_package(spark)
    members = spark.read.format("binaryFile").load(paths).select("path").repartition("path") \
        .mapInPandas(_zip_members, "archive string, member string, error string")
    folder = scratch_folder(spark, "zip")
    members.write.parquet(f"{folder}/members")
    members = spark.read.parquet(f"{folder}/members")
    good = members.filter(F.col("error").isNull()).select("archive", "member").repartition("archive", "member")
    good.mapInPandas(_member_rows, ZIP_ROW_SCHEMA).write.parquet(f"{folder}/rows")
    frames, rejects = _parsed(spark.read.schema(ZIP_ROW_SCHEMA).parquet(f"{folder}/rows"))
    rejects = rejects.unionByName(members.filter(F.col("error").isNotNull()), allowMissingColumns=True)
    if not frames:
        return spark.createDataFrame([], "_src_file string, _src_row long"), rejects
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), rejects


def read_raw_with_rejects(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of all supported files of a folder: all-string rows with lineage columns, and
    (archive, member, row, error, text) of what was not read as it stands. An archive none of whose
    members gave a row is an error."""
    hidden = [(p, "", None, HIDDEN, None) for p in hidden_files(spark, data_dir)]
    files = _files(spark, data_dir)
    kind = {f["path"]: next(s for s in (CSV_SUFFIXES, ZIP_SUFFIXES, UNSUPPORTED_SUFFIXES) if f["path"].lower().endswith(s)) for f in files}
    unsupported = [p for p, k in kind.items() if k is UNSUPPORTED_SUFFIXES]
    if unsupported:
        raise ValueError("spreadsheet files are not read; convert them to CSV: " + ", ".join(unsupported))
    frames, rejects = [], spark.createDataFrame(hidden, REJECTS)
    if csvs := [f for f in files if kind[f["path"]] is CSV_SUFFIXES]:
        rows, bad = read_csv_files(spark, csvs)
        frames.append(rows)
        rejects = rejects.unionByName(bad)
    if zips := [p for p, k in kind.items() if k is ZIP_SUFFIXES]:
        rows, bad = read_zip_files(spark, zips)
        full = {r[0] for r in rows.select(F.split_part("_src_file", F.lit("!"), F.lit(1))).distinct().collect()}  # one per archive
        if empty := sorted(set(zips) - full):
            raise ValueError("archives without a readable CSV member: " + ", ".join(empty))
        frames.append(rows)
        rejects = rejects.unionByName(bad)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), rejects


def read_raw(spark: SparkSession, data_dir: str) -> DataFrame:
    """The rows of ``read_raw_with_rejects``."""
    return read_raw_with_rejects(spark, data_dir)[0]
