"""Records of quoted CSV from split files.

A quoted text may hold line breaks, so a split of a file does not know whether it starts inside one.
Each split is therefore read under both assumptions: what it does to a start outside and to a start
inside of quotes is one small row. A running composition of these rows over the splits of a file gives
every split its true start. Lines that are a record of their own pass as they are; only records of
several lines are put together by a shuffle, each on its own.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.session import cut

QUOTE = '"'
PLACED = "file string, start long, line long, value string, end0 boolean, end1 boolean, owner0 long, owner1 long, opens0 boolean, opens1 boolean"


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted text is open after the line. A quote opens at the start of a field only;
    doubled quotes stand for themselves."""
    at, size = 0, len(line)
    while True:
        if inside:
            at = line.find(QUOTE, at)
            if at < 0:
                return True
            if line.startswith(QUOTE, at + 1):
                at += 2
                continue
            inside = False
        elif at < size and line.startswith(QUOTE, at):
            inside, at = True, at + 1
            continue
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _placed(lines: DataFrame, sep: str) -> DataFrame:
    """Lines (file, start of the split, value in order) with their number in the split and, for a split
    that starts outside (0) or inside (1) of quotes: whether the line opens a record, which line of the
    split opened its record (null: one of an earlier split), and whether a quoted text stays open."""

    def work(batches):
        split, number, states, owners = None, 0, [False, True], [None, None]
        for batch in batches:
            out = {name: [] for name in ("line", "end0", "end1", "owner0", "owner1", "opens0", "opens1")}
            for file, start, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (file, start) != split:
                    split, number, states, owners = (file, start), 0, [False, True], [None, None]
                for way in (0, 1):
                    if not states[way]:
                        owners[way] = number
                    out[f"opens{way}"].append(not states[way])
                    out[f"owner{way}"].append(owners[way])
                if QUOTE in value:
                    # Once both ways agree they stay together, so most lines are looked at once.
                    after = ends_inside(value, states[0], sep)
                    states = [after, after if states[0] == states[1] else ends_inside(value, states[1], sep)]
                out["end0"].append(states[0])
                out["end1"].append(states[1])
                out["line"].append(number)
                number += 1
            long, flag = pa.int64(), pa.bool_()
            kinds = {"line": long, "end0": flag, "end1": flag, "owner0": long, "owner1": long, "opens0": flag, "opens1": flag}
            columns = {name: pa.array(out[name], kind) for name, kind in kinds.items()}
            yield pa.RecordBatch.from_pydict(
                {"file": batch.column(0), "start": batch.column(1), "line": columns.pop("line"), "value": batch.column(2), **columns}
            )

    return lines.mapInArrow(work, PLACED)


def _starts(placed: DataFrame) -> DataFrame:
    """file, start, inside, owner_start, owner_line: how each split starts, and the line that opened the
    record that is open there. One row for each split."""
    last = F.struct("line", "end0", "end1", "owner0", "owner1")
    splits = placed.groupBy("file", "start").agg(F.max(last).alias("l")).select("file", "start", "l.*")
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # A split that ends alike from both starts settles the state; one that turns them round flips it.
    settles, flips = F.col("end0") == F.col("end1"), F.col("end0") & ~F.col("end1")
    splits = splits.withColumn("_part", F.coalesce(F.sum(settles.cast("long")).over(before), F.lit(0)))
    splits = splits.withColumn("_base", F.coalesce(F.last(F.when(settles, F.col("end0")), ignorenulls=True).over(before), F.lit(False)))
    inner = Window.partitionBy("file", "_part").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # The settling split is the last of its part; flips before it do not count any more.
    turns = F.coalesce(F.sum((flips & ~settles).cast("long")).over(inner), F.lit(0))
    splits = splits.withColumn("inside", F.col("_base") != (turns % 2 == 1))
    owner = F.when(F.col("inside"), F.col("owner1")).otherwise(F.col("owner0"))
    opened = F.when(owner.isNotNull(), F.struct(F.col("start").alias("s"), owner.alias("l")))
    splits = splits.withColumn("_open", F.last(opened, ignorenulls=True).over(before))
    return splits.select("file", "start", "inside", F.col("_open.s").alias("owner_start"), F.col("_open.l").alias("owner_line"))


def read_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """value, first: the records of quoted CSV files with their line breaks, and whether a record is the
    first of its file. Lines end in a line feed, with or without a carriage return; empty lines are no
    records. Files are split, and no record, however many splits it crosses, needs more than its own
    text in a task. A quoted text that never ends takes the rest of its file.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    placed = _placed(lines, sep)
    # One row for each split, written, so that its size is known and lines stay where they are.
    known = placed.join(cut(_starts(placed)), ["file", "start"])

    def true_one(name: str):
        return F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    known = known.select(
        "file", "start", "line", "value", "owner_start", "owner_line", true_one("end").alias("open"), true_one("owner").alias("owner"), true_one("opens").alias("opens")
    )
    ends = F.regexp_replace("value", "\r$", "")
    first = (F.col("start") == 0) & (F.col("line") == 0)
    alone = known.filter(F.col("opens") & ~F.col("open")).select(ends.alias("value"), first.alias("first"))
    parts = known.filter(~(F.col("opens") & ~F.col("open"))).select(
        "file",
        F.when(F.col("owner").isNull(), F.col("owner_start")).otherwise(F.col("start")).alias("_start"),
        F.coalesce("owner", "owner_line").alias("_line"),
        F.struct("start", "line", "value").alias("_part"),
    )
    whole = parts.groupBy("file", "_start", "_line").agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    joined = whole.select(
        F.array_join(F.transform("_parts", lambda p: p["value"]), "\n").alias("value"), ((F.col("_start") == 0) & (F.col("_line") == 0)).alias("first")
    )
    joined = joined.select(F.regexp_replace("value", "\r$", "").alias("value"), "first")
    return alone.unionByName(joined).filter((F.col("value") != "") | F.col("first"))
