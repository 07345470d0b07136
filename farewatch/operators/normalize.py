"""Raw text rows -> typed transactions (one projection and two filters; no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewatch.config import NULL_TOKENS
from farewatch.sources.fixture import with_calendar

REQUIRED = ("DATE", "CARD", "TRM_ID")
KEY_TEXT_COLUMNS = ("CARD", "TRM_ID", "ROUTE_NUM", "CAT", "CAT_TYPE", "TRC_ID")
LINEAGE = ("_src_file", "_src_row")
# fixed value: dd.mm.yyyy HH:MM:SS, padding optional
DATE_TEXT = r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"


def strip_text(c: Column) -> Column:
    """Python ``str.strip()``: unicode whitespace at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_date(c: Column) -> Column:
    """``dd.mm.yyyy HH:MM:SS`` (padding optional) -> TIMESTAMP_NTZ; unparseable -> null."""
    return date_of(date_parts(c))


def date_parts(c: Column) -> Column:
    """The six numbers of a date text, null if it is none."""
    return F.split(F.when(c.rlike(DATE_TEXT), c), r"[. :]+")


def date_of(part: Column) -> Column:
    return F.try_make_timestamp_ntz(*[F.get(part, F.lit(k)).cast("int") for k in (2, 1, 0, 3, 4)],
                                    F.get(part, F.lit(5)).cast("decimal(16,6)"))


def to_integral(c: Column, target: str) -> Column:
    """Numeric text (``'0201'``, ``'201.0'``) -> integer; non-numeric or fractional -> null (a
    fractional category stays in the text column, see the unknown-category rule)."""
    d = c.try_cast("double")
    return F.when(d == F.floor(d), d.try_cast(target))


def null_tokens(c: Column) -> Column:
    return F.when(~c.isin(*NULL_TOKENS), c)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are computed once a row. Filters on a plain projection are moved
    below it and repeat its expressions in every condition; they stay above a generator."""
    rest = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*[v.alias(c) for c, v in columns.items()])))).select(*df.columns, *[c for c in columns if c not in df.columns])


def normalize_header(df: DataFrame) -> DataFrame:
    names = [c if c in LINEAGE else c.strip().upper() for c in df.columns]
    return df.toDF(*names)


def normalize_transactions(raw: DataFrame) -> DataFrame:
    """Header trim+upper, embedded header rows dropped, every text column stripped, date parsed,
    sentinels nulled, rows without date/card/terminal dropped, category and amount coerced.
    Returns ``schemas.TX_COLUMNS``."""
    df = normalize_header(raw)
    missing = sorted(set(REQUIRED) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    text_cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name not in LINEAGE]
    # every text column is stripped, then missing-value tokens become null in it
    df = once(df, {c: strip_text(F.col(c)) for c in text_cols})
    df = df.select(*[null_tokens(F.col(c)).alias(c) if c in text_cols else F.col(c) for c in df.columns])
    df = df.filter(F.coalesce(F.upper("DATE") != "DATE", F.lit(True)))
    df = once(df, {"_date_parts": date_parts(F.col("DATE"))})

    def opt(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    key = {c: opt(c) for c in KEY_TEXT_COLUMNS}
    src_file = F.col("_src_file") if "_src_file" in df.columns else F.input_file_name()
    src_row = F.col("_src_row") if "_src_row" in df.columns else F.monotonically_increasing_id()
    typed = df.select(
        key["CARD"].alias("card"),
        key["TRM_ID"].alias("trm_id"),
        key["ROUTE_NUM"].alias("route_num"),
        key["TRC_ID"].alias("trc_id"),
        key["CAT"].alias("cat"),
        key["CAT_TYPE"].alias("cat_type"),
        to_integral(key["CAT"], "int").alias("cat_num"),
        opt("SUMM").try_cast("double").alias("summ_num"),
        F.coalesce(opt("VEHICLE"), F.lit("")).alias("vehicle"),
        date_of(F.col("_date_parts")).alias("dt"),
        src_file.cast("string").alias("src_file"),
        src_row.cast("bigint").alias("src_row"),
    ).filter(F.col("dt").isNotNull() & F.col("card").isNotNull() & F.col("trm_id").isNotNull())
    return with_calendar(typed)
