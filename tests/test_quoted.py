"""Quoted CSV read by splits, against one task per file."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from knotwork.sources import quoted, tables

PIECES = ["a", "b c", "line\nbreak", "two\n\nbreaks\n", '"', '""', ",", ', "x", ', "\n", "\r\n", "ü", "", " ", '5" pipe', "'", "\n,\n\"\n"]


def written(rows, end="\n", always=False):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL if always else csv.QUOTE_MINIMAL).writerows(rows)
    return out.getvalue()


def rows_of(seed, n):
    draw = random.Random(seed)
    return [(f"k{seed}-{i}", "".join(draw.choices(PIECES, k=draw.randint(1, 4))), "".join(draw.choices(PIECES, k=2)) + "x") for i in range(n)]


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.mark.parametrize("size", [64, 1000, 10_000_000])
def test_many_splits_give_the_one_task_result(spark, tmp_path, size):
    header = [("key", "note", "more, of\nit")]
    wanted = []
    for seed, (end, always) in enumerate([("\n", False), ("\r\n", False), ("\n", True)]):
        rows = rows_of(seed, 150) + [(f"long{seed}", 'y"\n,' * 400, "end")]
        # An empty text without quotes is null.
        wanted += [tuple(text if text or always else None for text in row) for row in rows]
        (tmp_path / f"{seed}.csv").write_bytes(written(header + rows, end, always).encode())
    one_task = spark.read.csv(str(tmp_path), multiLine=True, **tables.CSV_OPTIONS)
    plain = sorted(map(tuple, one_task.collect()), key=str)
    try:
        small_splits(spark, size)
        found = tables.read_feature_table(spark, str(tmp_path))
        lines = spark.read.text(str(tmp_path), lineSep="\n")
        if size == 64:
            assert lines.rdd.getNumPartitions() > 50
        got = sorted(map(tuple, found.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found.columns == list(header[0])
    assert got == sorted(wanted, key=str)
    # The one-task reader takes the line break in the header of file 1 for the end of its lines.
    assert [r for r in got if r[0][:2] != "k1" and r[0] != "long1"] == [r for r in plain if r[0][:2] != "k1" and r[0] != "long1"]


@pytest.mark.parametrize(
    "line, outside, inside",
    [("a,b", False, True), ('"a', True, False), ('a"', False, False), ('x,"a', True, False), ('"a""', True, False), ('"a"",b', True, False), ('5" x,b', False, False), ("", False, True), ('""', False, True), ('b",c', False, False)],
)
def test_line_states(line, outside, inside):
    assert quoted.ends_inside(line, False, ",") is outside
    assert quoted.ends_inside(line, True, ",") is inside


def test_empty_files_and_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("key,x\n\n1,2\n\n\n3,\"4\n\n5\"\n")
    found = tables.read_feature_table(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [("1", "2"), ("3", "4\n\n5")]
    (tmp_path / "a.csv").write_text("key,x\n")
    assert tables.read_feature_table(spark, str(tmp_path)).select(F.col("x")).collect() == []
