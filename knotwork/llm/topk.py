"""Exact top-k search by inner product with M-trees.

Vectors are dealt by a hash to blocks of bounded size. A task gets one block of vectors and one
block of queries, loads the vectors into an M-tree (pages of entries with covering radius and
distance to the parent) and answers each query best-first: pages come off a heap by the highest
score that they may hold, and entries whose stored distance to the parent already rules them out
are passed over without computing theirs. The blocks' lists of k are merged by query.

Scores are exact integers: where they and the sums on the way to them fit into the 53 bits of a
double, the product of doubles is one; elsewhere products of doubles only choose, with room for
their rounding, whom to compute in whole numbers. A bound is rounded down; a page whose bound equals
the worst kept score is skipped when its least id cannot win the tie. The metric is the Euclidean
one; with d the distance, 2 q.x = |q|^2 + |x|^2 - d^2, so a lower bound on d and the greatest norm
in a page bound every score in it.

Defined results: vectors that are null or hold a null or non-finite component take no part, as
query or candidate; rows without an id take no part; vectors of fewer components count as filled
up with zeros; components and scores beyond 64 bits are held at the ends of that range, where
ties go by id; repeated rows are candidates each, in blocks of their own; a repeated query id takes
the least of its vectors; ties go to the smaller id; extra columns, whatever their names, are left aside;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.blocks import block_join
from knotwork.session import cut

# Entries of a page: in noise nearly all pages are read, and a long product costs little more than a short one.
PAGE = 512
SCALE = 1024
LONG, LEAST = 2**63 - 1, -(2.0**63)


def integer_components(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, null where the vector takes no part."""
    values = vector.cast("array<double>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(values, lambda x: F.floor(x * scale)))


class Page:
    """A node: entries by their centers, radii, distances to this page's own center, greatest norms and least ids."""

    __slots__ = ("center", "radius", "norm", "least", "points", "to_center", "radii", "norms", "ids", "whole", "children")

    def __init__(self, center: np.ndarray):
        self.center = center
        self.children: list[Page] | None = None


def _leaf(points: np.ndarray, ids: np.ndarray, whole: np.ndarray) -> Page:
    page = Page(points.mean(axis=0))
    page.points, page.ids, page.whole = points, ids, whole
    page.to_center = np.sqrt(((points - page.center) ** 2).sum(axis=1))
    page.radii = np.zeros(len(points))
    page.norms = (points**2).sum(axis=1)
    page.radius, page.norm, page.least = page.to_center.max(), page.norms.max(), int(ids.min())
    return page


def build(whole: np.ndarray, ids: np.ndarray) -> Page:
    """The M-tree over integer points, loaded from above: entries gather round far-apart members."""
    points = whole.astype(np.float64)
    if len(points) <= PAGE:
        return _leaf(points, ids, whole)
    chosen = [int(np.argmin(ids))]
    distance = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    owner = np.zeros(len(points), dtype=np.int64)
    for number in range(1, min(PAGE, -(-len(points) // PAGE) + 1)):
        far = int(distance.argmax())
        if distance[far] == 0.0:
            break
        chosen.append(far)
        own = ((points - points[far]) ** 2).sum(axis=1)
        owner[own < distance] = number
        distance = np.minimum(distance, own)
    if len(chosen) == 1:
        # Only copies of one vector: pages by id.
        order = np.argsort(ids, kind="stable")
        step = max(PAGE, -(-len(ids) // PAGE))
        parts = [order[i : i + step] for i in range(0, len(order), step)]
        if len(parts) == 1:
            return _leaf(points, ids, whole)
    else:
        parts = [np.flatnonzero(owner == n) for n in range(len(chosen))]
    children = [build(whole[p], ids[p]) for p in parts if len(p)]
    page = Page(points.mean(axis=0))
    page.children = children
    page.points = np.stack([c.center for c in children])
    page.radii = np.array([c.radius for c in children])
    page.norms = np.array([c.norm for c in children])
    page.ids = np.array([c.least for c in children])
    page.to_center = np.sqrt(((page.points - page.center) ** 2).sum(axis=1))
    page.radius = float((page.to_center + page.radii).max())
    page.norm, page.least = page.norms.max(), int(page.ids.min())
    return page


def exact_products(whole: np.ndarray, query: np.ndarray, bound: float) -> list[int]:
    """Integer inner products, of which all sums on the way are below ``bound`` in size."""
    if bound < 2.0**62:
        return (whole @ query).tolist()
    products = whole.astype(object) @ query.astype(object)
    return [min(max(int(p), -LONG - 1), LONG) for p in products]


def search(root: Page, whole_query: np.ndarray, own_id: int, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best candidates but the query's own row, best first."""
    query = whole_query.astype(np.float64)
    length = float(query @ query)
    best: list[tuple[int, int]] = []  # heap: worst on top; ids negated, as the smaller one wins
    slack = 1e-10 * (length + root.norm) + 1e-6
    # No sum of some of the products of two vectors exceeds the product of their lengths.
    reach = 1.001 * float(np.sqrt(length * root.norm))
    doubles = reach < 2.0**52

    def worst() -> tuple[float, int]:
        return best[0] if len(best) == k else (-np.inf, 0)

    first = float(np.sqrt(((query - root.center) ** 2).sum()))
    heap: list[tuple[float, int, float, int, Page]] = [(-np.inf, root.least, first, 0, root)]
    count = 0
    while heap:
        bound, least, distance, _, page = heapq.heappop(heap)
        floor, last = worst()
        if -bound < floor:
            break
        if len(best) == k and -bound <= floor and least > -last:
            continue
        # Bounds from the stored distances to the page's center, without computing any distance.
        nearest = np.maximum(0.0, np.abs(distance - page.to_center) - page.radii)
        above = np.maximum(np.floor((length + page.norms - nearest**2) / 2 + slack), LEAST)
        open_ = np.flatnonzero(above >= floor)
        if not len(open_):
            continue
        if page.children is None:
            scores = np.maximum(page.points[open_] @ query, LEAST)
            keep = open_[(scores >= floor - (0.0 if doubles else slack)) & (page.ids[open_] != own_id)]
            if doubles:
                found = (page.points[keep] @ query).astype(np.int64).tolist()
            else:
                found = exact_products(page.whole[keep], whole_query, reach)
            for score, id_ in zip(found, page.ids[keep].tolist()):
                entry = (score, -id_)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            continue
        real = np.sqrt(((page.points[open_] - query) ** 2).sum(axis=1))
        nearest = np.maximum(0.0, real - page.radii[open_])
        above = np.maximum(np.floor((length + page.norms[open_] - nearest**2) / 2 + slack), LEAST)
        for place in np.flatnonzero(above >= floor).tolist():
            count += 1
            child = page.children[open_[place]]
            heapq.heappush(heap, (-float(above[place]), child.least, float(real[place]), count, child))
    return [(score, -negative) for score, negative in sorted(best, key=lambda e: (-e[0], -e[1]))]


def padded_matrix(column: pa.ChunkedArray | pa.Array, width: int, kind=np.float64) -> np.ndarray:
    """A list column as rows of ``width`` numbers; shorter lists are filled up with zeros."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(np.asarray(rows.offsets))
    flat = np.asarray(rows.flatten(), dtype=kind)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=kind)
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths]) if len(flat) else []] = flat
    return out


def top_products(rows: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products.

    ``rows`` has vec_id and embedding; queries are the rows whose id is divisible by ``every``.
    """
    whole = F.size("vec") >= 0
    known = rows.select(F.col("vec_id").cast("long").alias("vec_id"), integer_components(F.col("embedding")).alias("vec"))
    # Rows are dealt by their place, as an id may repeat.
    known = known.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & whole)
    known = cut(known.withColumn("row", F.monotonically_increasing_id()))
    queries = known.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec"))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            width = max(pc.max(pc.list_value_length(t.column("vec"))).as_py() for t in (left, right))
            ids = np.asarray(left.column("vec_id"))
            tree = build(padded_matrix(left.column("vec"), width, np.int64), ids)
            for query_id, query in zip(right.column("query_id").to_pylist(), padded_matrix(right.column("vec"), width, np.int64)):
                found += [(query_id, id_, score) for score, id_ in search(tree, query, query_id, k)]
        names = ["query_id", "vec_id", "score"]
        columns = list(zip(*found)) if found else [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    counts = known.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    lists = block_join(known, queries, "row", "query_id", work, "query_id long, vec_id long, score long", counts[0], counts[1])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
