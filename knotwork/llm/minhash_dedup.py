"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. One pass over the texts gives each document the size and digest of its shingle set, 128 minima
   (16 trees of 8) and a sketch of four bits for each minimum. Documents with equal sets form one
   class; only the least id of a class goes on, so thousands of copies cost one row.
2. Each tree sorts the classes by its 8 minima over all tasks (range partitions, so the same prefix
   may fill many tasks). Neighbours in that order whose longest common prefix reaches the depth of
   their region become candidates when their sketches agree. The depth is ``LEAST_DEPTH`` and one
   deeper for each tenfold crowd that the window of a document meets at the lesser depth. The rows
   at the edges of the ranges are sorted once more among themselves, so that pairs over an edge count.
3. Candidates tie classes into groups, and a group is cut into blocks. A class goes to the pairs of
   blocks in which it has a candidate, so a crowd of texts that look alike costs a class no more
   copies than it has candidates, and a group of one block one copy. Each pair of blocks is one
   task of bounded size that compares all its classes exactly on their full shingle sets and
   returns a spanning forest of the links, never the pairs.
4. The least document reachable over confirmed links names the component.

A pair at similarity 0.85 differs within the prefix of 3 in all 16 trees with a chance of 2e-7, and fails
the sketch with one of 3e-7. Where more than ``WINDOW`` classes share a prefix, a pair may lie
further apart than the window in a tree; other trees, the greater depth and the comparison of whole
blocks make up for that.

Defined results: a text without words (null, empty, blank) has ``n_shingles`` 0 and is linked with
nothing; repeated rows and repeated ids are linked through their id; a row with a null id takes no
part (component null, kept); a text of any length is one set, held by a task as a whole; further
columns of the input are left aside by ``near_duplicates`` and kept by ``keep_first``; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import Forest, components, set_digest, shingle_sets, text_slices, without
from knotwork.session import cut

TREES = 16
TREE_HASHES = 8
LEAST_DEPTH = 3
# Documents before a document in the sorted order of a tree that are looked at.
WINDOW = 8
# Of 128 minima those whose four bits must agree in a pair: at similarity 0.85 this is 5 deviations down.
SKETCH_EQUAL = 90
# Rows at the edges of ranges that one task sorts.
EDGE_ROWS = 100_000
# Classes on each side of a pair of blocks.
BLOCK_ROWS = 256
# Cells of the shingle matrix of a block pair that are held at once.
MATRIX_CELLS = 16_000_000

_SEEDS = np.random.default_rng(20240229).integers(1, 2**63, TREES * TREE_HASHES, dtype=np.uint64) | np.uint64(1)
_KEY_BYTES = 2 * TREE_HASHES


def minima(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of 32-bit minima for each set; the sets must not be empty."""
    out = np.empty((len(offsets) - 1, len(_SEEDS)), dtype=np.uint32)
    for j, seed in enumerate(_SEEDS):
        out[:, j] = np.minimum.reduceat((values * seed) >> np.uint64(32), offsets[:-1])
    return out


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cls (digest of the set), keys (all trees), sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            values, offsets = shingle_sets(batch.column(1))
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            keys, sketches, digests = [[None] * len(batch) for _ in range(3)]
            if len(full):
                rows = minima(values, np.concatenate([offsets[full], [offsets[-1]]]))
                packed = (rows & np.uint32(0xFFFF)).astype(">u2")
                four = (rows >> np.uint32(16) & np.uint32(15)).astype(np.uint8)
                bits = four[:, ::2] << 4 | four[:, 1::2]
                for place, i in enumerate(full):
                    keys[i] = packed[place].tobytes()
                    sketches[i] = bits[place].tobytes()
                    digests[i] = set_digest(values[offsets[i] : offsets[i + 1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), *[pa.array(x, pa.binary()) for x in (digests, keys, sketches)]],
                names=["doc_id", "n_shingles", "cls", "keys", "sketch"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, "doc_id long, n_shingles long, cls binary, keys binary, sketch binary")


_FOURS = np.uint64(0x1111111111111111)


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many groups of four bits are equal in each pair of sketches."""
    differ = a ^ b
    differ |= differ >> np.uint64(2)
    differ |= differ >> np.uint64(1)
    return 16 * a.shape[1] - np.bitwise_count(differ & _FOURS).sum(axis=1, dtype=np.int64)


_FOUND = "src long, dst long, tie boolean, edge struct<tree: int, key: binary, rep: long, sketch: binary>"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (src, dst) from rows tree, key, rep, sketch in the order of the forest.

    ``tie`` marks those that hold a batch's groups together. The first and last rows of the task
    come out as ``edge``, without a pair.
    """
    held: tuple[np.ndarray, ...] | None = None
    first = last = None

    def found(src: np.ndarray, dst: np.ndarray, ties: np.ndarray, edges: pa.RecordBatch | None = None) -> pa.RecordBatch:
        edge_type = pa.struct([("tree", pa.int32()), ("key", pa.binary()), ("rep", pa.int64()), ("sketch", pa.binary())])
        if edges is None:
            edge = pa.nulls(len(src), edge_type)
        else:
            edge = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(edges.columns, edge_type)], fields=list(edge_type))
        pair = [pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(ties, pa.bool_())]
        if edges is not None:
            pair = [pa.nulls(len(edge), x.type) for x in pair]
        return pa.RecordBatch.from_arrays([*pair, edge], names=["src", "dst", "tie", "edge"])

    for batch in batches:
        if not len(batch):
            continue
        if first is None:
            first = batch.slice(0, WINDOW)
        tail = batch.slice(max(0, len(batch) - WINDOW))
        if last is not None and len(tail) < WINDOW:
            both = pa.Table.from_batches([last, tail])
            tail = both.slice(max(0, len(both) - WINDOW)).combine_chunks().to_batches()[0]
        last = tail
        tree = np.asarray(batch.column(0))
        key = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=">u2").reshape(-1, TREE_HASHES)
        rep = np.asarray(batch.column(2))
        sketch = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint64).reshape(len(batch), -1)
        fresh = 0
        if held is not None:
            fresh = len(held[0])
            tree, key, rep, sketch = [np.concatenate(pair) for pair in zip(held, (tree, key, rep, sketch))]
        prefixes = []
        for back in range(1, WINDOW + 1):
            equal = (key[back:] == key[:-back]) & (tree[back:] == tree[:-back])[:, None]
            prefixes.append(np.concatenate([np.zeros(min(back, len(key)), np.int64), np.cumprod(equal, axis=1).sum(axis=1)]))
        shared = np.stack(prefixes)
        # A region that fills the whole window at a depth is looked at one level deeper, as long as
        # the deeper level still leaves a neighbour.
        depth = np.full(len(tree), LEAST_DEPTH)
        for level in range(LEAST_DEPTH + 1, TREE_HASHES):
            crowded = (shared >= level).sum(axis=0) > WINDOW // 2
            depth = np.where(crowded & ((shared >= level - 1).sum(axis=0) == WINDOW), level, depth)
        src, dst = [], []
        for back in range(1, WINDOW + 1):
            at = np.flatnonzero(shared[back - 1] >= depth)
            at = at[(at >= fresh) & (at >= back)]
            at = at[_agreeing(sketch[at], sketch[at - back]) >= SKETCH_EQUAL]
            src.append(rep[at])
            dst.append(rep[at - back])
        a, b = np.concatenate(src), np.concatenate(dst)
        a, b = np.maximum(a, b)[a != b], np.minimum(a, b)[a != b]
        forest = Forest()
        ties = np.fromiter((forest.union(x, y) for x, y in zip(a.tolist(), b.tolist())), bool, len(a))
        yield found(a, b, ties)
        held = tuple(x[-WINDOW:] for x in (tree, key, rep, sketch))
    if first is not None:
        for edges in (first, last):
            yield found(np.zeros(0), np.zeros(0), np.zeros(0, bool), edges)


def forest_candidates(classes: DataFrame) -> DataFrame:
    """src, dst (larger and smaller rep), tie of neighbours in any tree."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = classes.select(tree.alias("tree"), "rep", "keys", "sketch").select(
        "tree", F.expr(f"substring(keys, tree * {_KEY_BYTES} + 1, {_KEY_BYTES})").alias("key"), "rep", "sketch"
    )
    placed, pairs, last = rows.repartitionByRange("tree", "key", "rep"), None, False
    while True:
        found = cut(placed.sortWithinPartitions("tree", "key", "rep").mapInArrow(_neighbours, _FOUND))
        level = found.filter(F.col("src").isNotNull()).select("src", "dst", "tie")
        pairs = level if pairs is None else pairs.unionByName(level)
        if last:
            return pairs.groupBy("src", "dst").agg(F.max("tie").alias("tie"))
        edges = found.filter(F.col("src").isNull()).select("edge.*").distinct()
        count = edges.count()
        last = count <= EDGE_ROWS
        placed = edges.coalesce(1) if last else edges.repartitionByRange(-(-count // EDGE_ROWS), "tree", "key", "rep")


def _links(table: pa.Table, percent: int) -> pa.Table:
    """A spanning forest of the links between classes of one block pair, compared on full sets."""
    reps = np.asarray(table.column("rep"))
    sides = np.asarray(table.column("side"))
    sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    rows = np.repeat(np.arange(len(sets)), sizes)
    ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    shared = np.flatnonzero(counts > 1)
    place = np.full(len(counts), -1)
    place[shared] = np.arange(len(shared))
    column = place[ids]
    rows, column = rows[column >= 0], column[column >= 0]
    left = np.flatnonzero(sides <= 0)
    right = np.flatnonzero(sides >= 0) if (sides != 0).any() else left
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    step = max(1, MATRIX_CELLS // max(1, len(sets)))
    for low in range(0, len(shared), step):
        a, b = np.searchsorted(column, [low, low + step])
        matrix = np.zeros((len(sets), min(step, len(shared) - low)), dtype=np.float32)
        matrix[rows[a:b], column[a:b] - low] = 1.0
        # Products of at most 2^24 ones are exact in single precision; larger sets are added up in strips.
        common += matrix[left] @ matrix[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common.astype(np.int64)
    found = np.argwhere(100 * common.astype(np.int64) >= percent * union)
    forest, src, dst = Forest(), [], []
    for i, j in found:
        a, b = int(reps[left[i]]), int(reps[right[j]])
        if a != b and forest.union(a, b):
            src.append(max(a, b))
            dst.append(min(a, b))
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


def wanted_blocks(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """rep, component, own, others: each class's block in its group, and the blocks that hold a candidate of it."""
    sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    members = groups.join(sizes, "component")
    joined = candidates.join(members, F.col("src") == F.col("key"))

    def block(column: str):
        return F.pmod(F.xxhash64(column), F.col("blocks")).cast("int")

    both = F.array(
        F.struct(F.col("src").alias("rep"), block("src").alias("own"), block("dst").alias("other")),
        F.struct(F.col("dst").alias("rep"), block("dst").alias("own"), block("src").alias("other")),
    )
    ends = joined.select("component", F.inline(both))
    return ends.groupBy("rep", "component", "own").agg(F.collect_set("other").alias("others"))


def confirmed_links(documents: DataFrame, classes: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """src, dst: links that hold the classes together that ``wanted`` brings to the same pair of blocks, exact on full sets."""
    members = wanted.join(classes.select("rep", "cls"), "rep")
    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that repeat meet in one task, and one of them is enough
        for batch in text_slices(batches):
            values, offsets = shingle_sets(batch.column(5))
            own = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            fresh = []
            for rep, found, cls in zip(batch.column(0).to_pylist(), own, batch.column(4).to_pylist()):
                fresh.append(rep not in seen and set_digest(found) == cls)
                if fresh[-1]:
                    seen.add(rep)
            shingles = pa.array([s.tobytes() for s in own], pa.binary())
            out = pa.RecordBatch.from_arrays([*batch.columns[:4], shingles], names=["rep", "component", "own", "others", "shingles"])
            yield out.filter(pa.array(fresh, pa.bool_()))

    rows = members.join(texts, "rep").select("rep", "component", "own", "others", "cls", "text").mapInArrow(
        sets, "rep long, component long, own int, others array<int>, shingles binary"
    )
    pairs = rows.withColumn("other", F.explode("others")).select(
        "component",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        F.signum(F.col("own") - F.col("other")).cast("int").alias("side"),
        "rep",
        "shingles",
    )
    return pairs.groupBy("component", "low", "high").applyInArrow(lambda t: _links(t, percent), "src long, dst long")


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``documents`` (doc_id, text)."""
    signed = cut(signatures(documents))
    with_words = signed.filter(F.col("cls").isNotNull() & F.col("doc_id").isNotNull())
    classes = cut(
        with_words.groupBy("cls").agg(
            F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")
        )
    )
    candidates = cut(forest_candidates(classes))
    groups = components(candidates.filter("tie"))
    # Written, so that no task holds two Python workers at once.
    links = cut(confirmed_links(documents, classes, wanted_blocks(candidates, groups), percent))
    # Rows that repeat an id with another text tie their classes together.
    again = with_words.groupBy("doc_id").agg(F.min("cls").alias("cls"), F.max("cls").alias("last")).filter("cls <> last")
    ties = (
        with_words.join(again.select("doc_id"), "doc_id")
        .select("cls", "doc_id")
        .distinct()
        .join(classes.select("cls", "rep"), "cls")
        .select(F.greatest("rep", "doc_id").alias("src"), F.least("rep", "doc_id").alias("dst"))
    )
    found = components(links.unionByName(ties.filter("src <> dst")))
    named = classes.select("cls", "rep").join(found, F.col("rep") == F.col("key"), "left")
    named = named.select(F.col("cls").alias("_cls"), F.coalesce("component", "rep").alias("component_id"))
    rows = signed.select("doc_id", "n_shingles", "cls").join(named, F.col("cls") == F.col("_cls"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_first(documents: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``documents`` whose id names its component, with all their columns."""
    return without(documents, near_duplicates(documents, percent).filter(~F.col("kept")))
