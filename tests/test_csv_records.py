"""CSV records read by many tasks against the reader that takes a file whole."""

from __future__ import annotations

import random

import pytest

from retentio.sources import csv_records
from retentio.sources.csv_ingest import read_raw_csv


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def by_one_task(spark, path):
    return spark.read.options(**csv_records.DIALECT, header="true", multiLine="true", mode="FAILFAST").csv(str(path))


@pytest.fixture
def small_ranges(spark):
    """Files are cut every 64 bytes, so records run over many ranges."""
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


ODD = {
    "plain": "a,b,c\n1,2,3\n4,5,6\n",
    "breaks": 'a,b,c\n1,"x\ny",3\n"\n\n",5,6\n7,8,"9\n"\n',
    "long": 'a,b,c\n1,"' + "line of text\n" * 60 + '",3\n' + "4,5,6\n" * 40 + '7,"' + "\n" * 100 + '",9\n',
    "doubled": 'a,b,c\n"he said ""no""\n""yes""",2,3\n"""",""," "\n"a""\n""b","""\n""","\n"""\n',
    "commas": 'a,b,c\n"1,2\n3,4","5,\n",6\n"\n,",",\n,","\n,"\n',
    "crlf": 'a,b,c\r\n1,"x\r\ny",3\r\n4,5,6\r\n7,"8",9\r\n',
    "no last line feed": 'a,b,c\n1,"x\ny",3\n4,5,"z\n"',
    "blank lines": 'a,b,c\n\n1,"x\n\ny",3\n\n\n4,5,6\n\n',
    "quote within a plain field": 'a,b,c\n5" pipe,2,3\n1,6" x 7",3\n4,"5\n",6\n',
    "header with a break": '"a\nx",b,c\n1,2,3\n4,"5\n5",6\n',
    "empty and missing": 'a,b,c\n,"",\n"x\n",,""\n',
    "other letters": 'a,b,c\nß,"漢\n字",😀\n',
    "header only": "a,b,c\n",
}


@pytest.mark.parametrize("name", list(ODD))
def test_odd_files_equal_the_whole_file_reader(spark, tmp_path, small_ranges, name):
    (tmp_path / "x.csv").write_bytes(ODD[name].encode())
    got, want = csv_records.read_csv_text(spark, str(tmp_path / "x.csv")), by_one_task(spark, tmp_path / "x.csv")
    assert got.columns == want.columns
    assert rows_of(got) == rows_of(want)


def test_lines_that_set_the_state(spark, tmp_path, small_ranges):
    """A plain field with one quote: outside it changes nothing, inside it would close the field."""
    text = "a,b,c\n" + '1,"open\nstill 5"" wide\nclosed",2\n3,5" pipe,4\n' * 30
    (tmp_path / "x.csv").write_text(text)
    got = rows_of(csv_records.read_csv_text(spark, str(tmp_path / "x.csv")))
    assert got == sorted([("1", 'open\nstill 5" wide\nclosed', "2"), ("3", '5" pipe', "4")] * 30, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_random_files(spark, tmp_path, small_ranges, seed):
    rng = random.Random(seed)
    folder = tmp_path / "many files"
    folder.mkdir()
    want = []
    for k in range(3):
        rows = [["".join(rng.choices('ab,"\n ', k=rng.randint(1, 12))) for _ in range(3)] for _ in range(40)]
        if k == 1:
            rows = [[v.replace("\n", "_") for v in r] for r in rows]
        want += [tuple(r) for r in rows]
        quoted = ["," .join('"' + v.replace('"', '""') + '"' for v in r) for r in rows]
        (folder / f"part {k}.csv").write_text("\n".join(["a,b,c", *quoted]) + "\n")
    assert rows_of(csv_records.read_csv_text(spark, str(folder))) == sorted(want, key=str)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "large.csv"
    with path.open("w") as f:
        f.write("a,b,c\n")
        for i in range(120_000):
            f.write(f'{i},"text of {i}\nand its ""second"" line",{"x" * 20}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        lines = csv_records.lines(spark, str(path))
        assert lines.select("block").distinct().count() >= 7
        df = read_raw_csv(spark, str(path))
        assert df.count() == 120_000 and df.where("b = concat('text of ', a, '\nand its \"second\" line')").count() == 120_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_clean_files_take_no_shuffle(spark, tmp_path, capsys):
    (tmp_path / "x.csv").write_text(ODD["plain"])
    csv_records.read_csv_text(spark, str(tmp_path / "x.csv")).explain()
    assert "Exchange" not in capsys.readouterr().out
