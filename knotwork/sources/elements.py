"""The elements below the root of XML files, read by splits.

Files are cut at each ``>``, so a record holds at most one tag, comment or section. A split does not know
where it starts: between tags, inside a quoted attribute, a comment or a section. Each split is read
from all these starts at once; what it does to each of them, the depth included, is one small row, and a
running composition over the splits of a file gives every split its true start. Elements that lie
in one split are passed on as they are; only those that cross a border are put together by a shuffle.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.session import cut

TEXT, OPEN, OPEN_DOUBLE, OPEN_SINGLE, DECL, DECL_DOUBLE, DECL_SINGLE, COMMENT, SECTION, INSTRUCTION = range(10)
OPENS = (OPEN, OPEN_DOUBLE, OPEN_SINGLE)
STATES = 10
SUBSET = re.compile(r"""<!DOCTYPE(?:[^"'\[]|"[^"]*"|'[^']*')*\[""")
# Elements of one split travel together up to this many characters.
PIECE = 1 << 16
# Tables with one row a split or a file go to every task up to this many bytes.
BESIDE_BYTES = 64 << 20


def _quotes(text: str, at: int, state: int) -> int:
    """State of an opening tag or a declaration after the text."""
    base = OPEN if state in OPENS else DECL
    inside = state - base
    while True:
        if inside:
            at = text.find('"' if inside == 1 else "'", at)
            if at < 0:
                return base + inside
            inside, at = 0, at + 1
            continue
        double, single = text.find('"', at), text.find("'", at)
        if double < 0 and single < 0:
            return base
        inside, at = (1, double + 1) if single < 0 or 0 <= double < single else (2, single + 1)


def step(state: int, text: str) -> tuple[int, int]:
    """State after a record and the ``>`` behind it, and the change of depth."""
    at = 0
    if state == TEXT:
        at = text.find("<")
        if at < 0:
            return TEXT, 0
        mark = text[at + 1 : at + 2]
        if mark == "/":
            return TEXT, -1
        if mark == "?":
            state, at = INSTRUCTION, at + 2
        elif mark != "!":
            state, at = OPEN, at + 1
        elif text.startswith("<!--", at):
            state, at = COMMENT, at + 4
        elif text.startswith("<![CDATA[", at):
            state, at = SECTION, at + 9
        else:
            subset = SUBSET.match(text, at)
            if subset:
                return step(TEXT, text[subset.end() :])
            state, at = DECL, at + 2
    if state == COMMENT:
        return (TEXT if text.endswith("--", at) else COMMENT), 0
    if state == SECTION:
        return (TEXT if text.endswith("]]", at) else SECTION), 0
    if state == INSTRUCTION:
        return (TEXT if text.endswith("?", at) else INSTRUCTION), 0
    state = _quotes(text, at, state)
    if state == DECL:
        return TEXT, 0
    if state == OPEN:
        return TEXT, 0 if text.endswith("/") else 1
    return state, 0


def _opening(state: int, text: str) -> bool:
    """Whether the record ends in an opening tag."""
    if state == TEXT:
        at = text.find("<")
        return at >= 0 and text[at + 1 : at + 2] not in ("/", "!", "?", "")
    return state in OPENS


def _effects(records: DataFrame) -> DataFrame:
    """file, start, ends, depths: for each state in which a split may start, the state in which it ends
    and by how much it changes the depth. One row for each split."""

    def row(split, ways):
        ends, depths = [0] * STATES, [0] * STATES
        for state, (depth, members) in ways.items():
            for first, extra in members:
                ends[first], depths[first] = state, depth + extra
        return pa.RecordBatch.from_pydict(
            {
                "file": pa.array([split[0]], pa.string()),
                "start": pa.array([split[1]], pa.int64()),
                "ends": pa.array([ends], pa.list_(pa.int32())),
                "depths": pa.array([depths], pa.list_(pa.int64())),
            }
        )

    def work(batches):
        split, ways = None, {}
        for batch in batches:
            for file, start, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (file, start) != split:
                    if split:
                        yield row(split, ways)
                    split, ways = (file, start), {s: (0, [(s, 0)]) for s in range(STATES)}
                after: dict[int, tuple[int, list]] = {}
                for state, (depth, members) in ways.items():
                    state, change = step(state, value)
                    depth += change
                    if state in after:
                        # Starts that have met stay together, apart from their depths.
                        first = after[state]
                        first[1].extend((s, extra + depth - first[0]) for s, extra in members)
                    else:
                        after[state] = (depth, members)
                ways = after
        if split:
            yield row(split, ways)

    return records.mapInArrow(work, "file string, start long, ends array<int>, depths array<long>")


def _starts(effects: DataFrame) -> DataFrame:
    """file, start, state, depth: how each split starts. Rows of a file stream past in order."""

    def work(batches):
        last, state, depth = None, TEXT, 0
        for batch in batches:
            states, levels = [], []
            for file, ends, depths in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if file != last:
                    last, state, depth = file, TEXT, 0
                states.append(state)
                levels.append(depth)
                depth, state = depth + depths[state], ends[state]
            yield pa.RecordBatch.from_pydict(
                {"file": batch.column(0), "start": batch.column(1), "state": pa.array(states, pa.int32()), "depth": pa.array(levels, pa.int64())}
            )

    ordered = effects.repartition("file").sortWithinPartitions("file", "start")
    return ordered.mapInArrow(work, "file string, start long, state int, depth long")


def _beside(rows: DataFrame, small: DataFrame, keys: list[str], texts: list[str]) -> tuple[DataFrame, bool]:
    """Rows with the columns of a written table next to them, and whether the rows kept their order:
    the table goes to every task if its bytes allow it, and is joined by shuffle otherwise."""
    size = small.agg(F.sum(sum(map(F.octet_length, texts), F.lit(64)))).first()[0] or 0
    if size <= BESIDE_BYTES:
        return rows.join(F.broadcast(small), keys), True
    return rows.join(small.hint("merge"), keys), False


def _pieces(known: DataFrame) -> DataFrame:
    """file, start, number, kind, opens, text: elements that lie in the split ("whole", several in a row),
    parts of those that do not ("part"), and what precedes them ("head", its last row "root")."""

    def work(batches):
        split, state, depth, number, size = None, TEXT, 0, 0, 0
        head, ready, open_parts, opens = [], [], [], False
        out: list[tuple] = []

        def put(kind, texts, opens=False):
            nonlocal number
            out.append((*split, number, kind, opens, "".join(texts)))
            number += 1
            texts.clear()

        def finish():
            if split:
                for kind, texts in (("head", head), ("whole", ready), ("part", open_parts)):
                    if texts:
                        put(kind, texts, opens and kind == "part")

        def batch_of():
            names = ("file", "start", "number", "kind", "opens", "text")
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_pydict(dict(zip(names, map(list, columns))))

        for batch in batches:
            for file, start, value, first, level in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (file, start) != split:
                    finish()
                    split, state, depth, number, size, opens = (file, start), first, level, 0, 0, False
                before, above = state, depth
                state, change = step(before, value)
                depth += change
                if above >= 2 or (above == 1 and before in OPENS):
                    open_parts.append(value + ">")
                elif above == 1:
                    if before != TEXT or not _opening(before, value):
                        continue
                    open_parts.append(value[value.find("<") :] + ">")
                    opens = True
                else:
                    head.append(value + ">")
                    if state == TEXT and _opening(before, value):
                        put("root", head)
                    continue
                if depth == 1 and state == TEXT:
                    if opens:
                        size += sum(map(len, open_parts))
                        ready.extend(open_parts)
                        open_parts.clear()
                        if size >= PIECE:
                            put("whole", ready)
                            size = 0
                    else:
                        put("part", open_parts)
                    opens = False
            if out:
                yield batch_of()
        finish()
        if out:
            yield batch_of()

    return known.mapInArrow(work, "file string, start long, number long, kind string, opens boolean, text string")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """file, start, number, head, text: the elements right below the root of XML files in UTF-8, some in a
    row, with all that precedes them in their file, root tag included; one row without text for each file.
    ``start`` and ``number`` name a row within its file.

    Files are split; an element below the root, however many splits it crosses, must fit into a task.
    The elements are written once to the shared folder. Empty files give nothing.
    """
    records = spark.read.text(path, lineSep=">").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    starts = cut(_starts(_effects(records)))
    known, ordered = _beside(records.withColumn("_at", F.monotonically_increasing_id()), starts, ["file", "start"], ["file"])
    if not ordered:
        known = known.sortWithinPartitions("file", "start", "_at")
    written = cut(_pieces(known.select("file", "start", "value", "state", "depth")))
    row = F.struct("start", "number", "kind", "text")
    heads = written.filter(F.col("kind").isin("head", "root")).groupBy("file").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    root = F.array_position(F.transform("rows", lambda r: r["kind"]), "root").cast("int")
    # Without a root all is kept, so that a reader finds the fault; text behind the root's end is no head.
    kept = F.slice("rows", F.lit(1), F.when(root > 0, root).otherwise(F.size("rows")))
    heads = cut(heads.select("file", F.array_join(F.transform(kept, lambda r: r["text"]), "").alias("head")))
    # The part without an opening belongs to the last opened one of the file.
    before = Window.partitionBy("file").orderBy("start", "number").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("opens"), F.col("start")), ignorenulls=True).over(before)
    parts = written.filter("kind = 'part'").withColumn("owner", owner).groupBy("file", "owner")
    joined = parts.agg(F.sort_array(F.collect_list(F.struct("start", "number", "text"))).alias("rows")).select(
        "file", F.col("owner").alias("start"), F.lit(-1).cast("long").alias("number"), F.array_join(F.transform("rows", lambda r: r["text"]), "").alias("text")
    )
    whole = written.filter("kind = 'whole'").select("file", "start", "number", "text").unionByName(joined)
    empty = heads.select("file", F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("number"), F.lit("").alias("text"))
    found, _ = _beside(whole.unionByName(empty), heads, ["file"], ["file", "head"])
    return found.select("file", "start", "number", "head", "text")
