import io
import os
import tempfile
import zipfile

import pandas as pd
import pytest

from farewatch.operators.normalize import normalize_transactions
from farewatch.sources.raw_files import HIDDEN, UNCLOSED, examine, layout, list_input_files, read_raw, read_raw_with_rejects, read_zip_files

HEADER = ["DATE", "CARD", "TRM_ID", "ROUTE_NUM", "CAT", "SUMM"]


def lines(sep, rows):
    return "\n".join([sep.join(HEADER)] + [sep.join(r) for r in rows]) + "\n"


def row(i, card="1"):
    return [f"09.05.2023 05:{i:02d}:00", card, "V1", "Маршрут 5", "0201", "100"]


def test_layout_from_the_whole_file():
    def of(data):
        _, charset, header, _ = examine(io.BytesIO(data))
        return (*layout(charset, header), charset)
    assert of("DATE;CARD\n".encode("cp1251")) == (";", ["DATE", "CARD"], "UTF-8")
    assert of("Дата,CARD\n".encode("cp1251")) == (",", ["ДАТА", "CARD"], "windows-1251")
    assert of(b"\xef\xbb\xbfdate \tCARD\r\n") == ("\t", ["DATE", "CARD"], "UTF-8")
    assert of(b"DATE|CARD\n")[0] == "|"
    long = "DATE;CARD\n" + "1;2\n" * 3_000_000
    assert of(long.encode() + "я;2\n".encode())[2] == "UTF-8"                    # decided by the last line, chunks later
    assert of(long.encode() + "я;2\n".encode("cp1251"))[2] == "windows-1251"
    assert of(long.encode() + "я".encode()[:1])[2] == "windows-1251"              # a character cut by the end of the file


def test_late_cyrillic_is_read_right(spark):
    d = tempfile.mkdtemp(prefix="fw-raw-")
    rows = [row(1) for _ in range(5000)] + [row(2)]
    for r in rows[:-1]:
        r[3] = "R1"
    open(os.path.join(d, "a.csv"), "wb").write(lines(";", rows).encode("cp1251"))
    got = read_raw(spark, d).groupBy("ROUTE_NUM").count().collect()
    assert {r["ROUTE_NUM"]: r["count"] for r in got} == {"R1": 5000, "Маршрут 5": 1}
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"


def test_fractional_amounts_and_categories(spark):
    d = tempfile.mkdtemp(prefix="fw-raw-")
    open(os.path.join(d, "a.csv"), "wb").write(lines(";", [["09.05.2023 05:01:00", "1", "V1", "R", "201.5", "10.5"], ["9.5.2023 5:1:7", "1", "V1", "R", "0201", "x"],
                                                           ["31.02.2023 05:01:00", "1", "V1", "R", "1", "1"]]).encode())
    got = normalize_transactions(read_raw(spark, d)).orderBy("dt").collect()
    assert [(r["summ_num"], r["cat_num"], r["cat"], r["second"]) for r in got] == [(10.5, None, "201.5", 0), (None, 201, "0201", 7)]


def test_rejects_are_returned(spark):
    d = tempfile.mkdtemp(prefix="fw-zip-")
    path = os.path.join(d, "z.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("m1.csv", '\ufeffDATE;CARD;TRM_ID;ROUTE_NUM\n01.02.2023 00:00:00;1;V1;"a;b\u2028\nc"\n\n01.02.2023 00:00:01;2;V1;\n')
        z.writestr("bad.csv", "DATE;CARD;TRM_ID\n" + "x" * 50)
        z.writestr("book.xlsx", b"no")
    data = open(path, "rb").read()
    open(path, "wb").write(data.replace(b"x" * 50, b"y" * 50))
    rows, rejects = read_raw_with_rejects(spark, d)
    assert sorted((r["CARD"], r["ROUTE_NUM"]) for r in rows.collect()) == [("1", "a;b\u2028\nc"), ("2", None)]
    assert sorted(r["member"] for r in rejects.collect()) == ["bad.csv", "book.xlsx"]
    with zipfile.ZipFile(os.path.join(d, "empty.zip"), "w") as z:
        z.writestr("readme.txt", "no tables")
    with pytest.raises(ValueError, match="empty.zip"):
        read_raw_with_rejects(spark, d)


def test_folder_ingest(spark):
    d = tempfile.mkdtemp(prefix="fw-raw-")
    open(os.path.join(d, "a.csv"), "wb").write(lines(";", [row(1), row(2)]).encode("cp1251"))
    open(os.path.join(d, "b.csv"), "wb").write(b"\xef\xbb\xbf" + lines(",", [row(3)]).encode("utf-8"))
    open(os.path.join(d, "c.csv"), "wb").write(lines("\t", [row(4)]).encode("utf-8"))
    open(os.path.join(d, "copy_of_a.csv"), "wb").write(lines(";", [row(1), row(2)]).encode("cp1251"))
    open(os.path.join(d, ".hidden.csv"), "wb").write(lines(";", [row(9)]).encode("utf-8"))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("m1.csv", lines(";", [row(5), row(6)]))
        z.writestr("sub/m2.csv", lines(";", [row(7)]))
        z.writestr("__MACOSX/._m1.csv", "junk")
        z.writestr("notes.txt", "ignored")
    open(os.path.join(d, "z.zip"), "wb").write(buf.getvalue())
    paths = list_input_files(spark, d)
    assert [os.path.basename(p) for p in paths] == ["a.csv", "b.csv", "c.csv", "z.zip"]
    tx = normalize_transactions(read_raw(spark, d))
    got = sorted((r["minute"], r["route_num"], r["cat_num"]) for r in tx.collect())
    assert [g[0] for g in got] == [1, 2, 3, 4, 5, 6, 7]
    assert {g[1] for g in got} == {"Маршрут 5"} and {g[2] for g in got} == {201}


def test_bad_zip_is_rejected(spark):
    d = tempfile.mkdtemp(prefix="fw-zip-")
    open(os.path.join(d, "broken.zip"), "wb").write(b"not a zip")
    rows, rejects = read_zip_files(spark, [os.path.join(d, "broken.zip")])
    assert rows.count() == 0 and rejects.count() == 1


QUOTED = ['DATE;CARD;TRM_ID;ROUTE_NUM', 'd1;c1;t1;"bus ""A"" one"', 'd2;c2;t2;"a;b"', 'd4;c4;t4;"C:\\"', 'd5;c5;t5;C:\\x\\', 'd6;c6', '', '   ', 'd7;c7;t7;5" pipe',
          'd8;c8;t8;""', 'd9;c9;t9; "q"', 'e1;e1;"t""4";"""A"" one"', 'e2;e2;t2;Маршрут "5"']


@pytest.mark.parametrize("charset", ["utf-8", "cp1251"])
@pytest.mark.parametrize("extra", [[], ['f1;f1;t1;"line 1', 'line ""2"""', 'f2;f2;t2;"x', '', 'y;z"'], ['g1;g1;t1;"ab"c', 'g2;g2;t2;"ab" "c"']])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quotes_are_read_as_pandas_reads_them(spark, charset, extra, end):
    d = tempfile.mkdtemp(prefix="fw-raw-")
    data = end.join(QUOTED + extra) + end
    open(os.path.join(d, "a.csv"), "wb").write(data.encode(charset))
    want = pd.read_csv(io.StringIO(data, newline=""), sep=";", dtype=str)
    rows, rejects = read_raw_with_rejects(spark, d)
    got = rows.orderBy("_src_file", "_src_row").select("DATE", "CARD", "TRM_ID", "ROUTE_NUM").collect()
    assert [tuple(r) for r in got] == [tuple(None if pd.isna(v) else v for v in r) for r in want.itertuples(index=False)]
    assert rows.count() == len(want)
    assert [(r["error"], r["text"]) for r in rejects.collect()] == [("row: 2 of 4 fields, the rest is missing", "d6;c6")]


@pytest.mark.parametrize("extra", [[], ['"k\nk";c;t;r'], ['"k"k;c;t;r']])
def test_rows_of_a_wrong_width_are_rejected(spark, extra):
    d = tempfile.mkdtemp(prefix="fw-raw-")
    body = ["DATE|CARD|TRM_ID|X", "1|2|3|4", "1|2|3|4|5", '1|"2|3"|4', '1|"2|3"|4|5|""', "1|2|3|", "1|2|3||", '5" a|6" b|7" c|8', "1"]
    data = "\n".join(body + [x.replace(";", "|") for x in extra])
    open(os.path.join(d, "a.csv"), "w").write(data)
    with zipfile.ZipFile(os.path.join(d, "z.zip"), "w") as z:
        z.writestr("m.csv", data.replace("|", ";"))
    rows, rejects = read_raw_with_rejects(spark, d)
    per_file = [("1", "2", "3", "4"), ("1", "2|3", "4", None), ("1", "2", "3", None), ('5" a', '6" b', '7" c', "8"), ("1", None, None, None)]
    per_file += [(x.split(";")[0].replace('"', ""), "c", "t", "r") for x in extra]
    got = sorted((tuple(r) for r in rows.select("DATE", "CARD", "TRM_ID", "X").collect()), key=str)
    zipped = [tuple(v and v.replace("|", ";") for v in r) for r in per_file]
    assert got == sorted(per_file + zipped, key=str)
    errors = ["row: 5 fields, the header has 4"] * 2 + ["row: 3 of 4 fields, the rest is missing", "row: 1 of 4 fields, the rest is missing"] + ["row: 5 fields, the header has 4"]
    assert sorted(r["error"] for r in rejects.collect()) == sorted(2 * errors)


def test_files_that_cannot_be_read_are_rejected(spark):
    d = tempfile.mkdtemp(prefix="fw-raw-")
    open(os.path.join(d, "a.csv"), "w").write(lines(";", [row(1)]))
    open(os.path.join(d, "open.csv"), "w").write(lines(";", [row(2)]) + '"never closes;1;2\n' + lines(";", [row(3)]))
    open(os.path.join(d, "_b.csv"), "w").write(lines(";", [row(4)]))
    open(os.path.join(d, ".c.csv"), "w").write(lines(";", [row(5)]))
    rows, rejects = read_raw_with_rejects(spark, d)
    assert rows.count() == 1
    assert sorted((os.path.basename(r["archive"]), r["error"]) for r in rejects.collect()) == [("_b.csv", HIDDEN), ("open.csv", UNCLOSED)]
