"""Delimited files whose quoted fields span lines, read in many splits."""

import csv
import io
import os
import tempfile

import numpy as np
import pytest

from quarry.sources.delimited import file_traits, read_delimited
from quarry.sources.ingest import numbered


@pytest.fixture
def tiny_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _write(name, text, encoding="utf-8"):
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-span-"), name)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return path


def _random_rows(seed, n, sep):
    rng = np.random.default_rng(seed)
    bits = ['"', sep, "\n", "a", "bc", " ", '""', "\n\n", "é"]
    return [[str(i)] + ["x" + "".join(rng.choice(bits, rng.integers(0, 6))) + "y" for _ in range(2)] for i in range(n)]


def _rows(df):
    return [list(r) for r in df.orderBy(df.columns[0]).collect()]


@pytest.mark.parametrize("name,encoding,end", [("a.csv", "utf-8", "\n"), ("b.tsv", "utf-8", "\n"), ("c.csv", "latin-1", "\n"), ("d.csv", "utf-8", "\r\n")])
def test_random_files_equal_a_whole_file_reader(spark, tiny_splits, name, encoding, end):
    sep = "\t" if name.endswith("tsv") else ","
    rows = _random_rows(3, 200, sep)
    text = io.StringIO()
    csv.writer(text, delimiter=sep, lineterminator=end).writerows([["id", "first text", "second"], *rows])
    path = _write(name, text.getvalue(), encoding)
    got = read_delimited(spark, [path])
    assert got.columns == ["id", "first text", "second"]
    plan = got._jdf.queryExecution().toString()
    assert "multiLine" not in plan and "FileScan text" in plan
    assert spark.read.text(path).rdd.getNumPartitions() >= 8
    assert sorted(_rows(got)) == sorted(rows)


def test_rows_keep_the_order_of_the_file(spark, tiny_splits):
    rows = [f'{i},"line one of {i}\nline two"\n' if i % 3 else f"{i},plain\n" for i in range(100)]
    path = _write("o.csv", "id,t\n" + "".join(rows))
    got = numbered(read_delimited(spark, [path], places=True)).select("id", "row_index").collect()
    assert sorted((r["row_index"], int(r["id"])) for r in got) == [(i, i) for i in range(100)]


def test_a_record_longer_than_many_splits(spark, tiny_splits):
    long = "\n".join(f"line {i}, of many" for i in range(150))
    path = _write("l.csv", f'id,t\n1,a\n2,"{long}"\n3,"{long}"\n\n4,"b\n"\n')
    assert _rows(read_delimited(spark, [path])) == [["1", "a"], ["2", long], ["3", long], ["4", "b\n"]]


def test_quotes_that_are_no_field_ends_take_the_whole_file_reader(spark, tiny_splits):
    loose = _write("p.csv", 'id,t\n1,5" pipe\n2,"two\nlines"\n3,6"\n')
    strict = _write("s.csv", 'id,t\n4,"three\nmore\nlines"\n5,""\n')
    assert file_traits(spark, [loose]).first()["spans_lines"]
    assert _rows(read_delimited(spark, [loose, strict])) == [["1", '5" pipe'], ["2", "two\nlines"], ["3", '6"'], ["4", "three\nmore\nlines"], ["5", None]]
    header = _write("h.csv", 'id,"a\nb"\n1,2\n')
    assert read_delimited(spark, [header]).columns == ["id", "a\nb"] and _rows(read_delimited(spark, [header])) == [["1", "2"]]


def test_short_and_long_records(spark, tiny_splits):
    path = _write("w.csv", 'id,t,u\n1\n2,"a\nb",c,extra\n3,NA,"N/A"\n')
    assert _rows(read_delimited(spark, [path])) == [["1", None, None], ["2", "a\nb", "c"], ["3", None, None]]


def test_lines_are_placed_once(spark, tmp_path):
    """The files were read and their lines placed again for every step that uses them; a file written anew is read anew."""
    path = tmp_path / "a.csv"
    for last in ("x", "z"):
        path.write_text(f'k,v\n1,"two\nlines"\n2,{last}\n')
        df = read_delimited(spark, [str(path)], places=True)
        assert "InMemoryTableScan" in df._jdf.queryExecution().toString()
        assert {(r["k"], r["v"]) for r in df.collect()} == {("1", "two\nlines"), ("2", last)}
