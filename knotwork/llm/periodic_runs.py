"""Periodic runs of words, found on a harmonic grid with longest common extensions.

A run is a stretch of words with smallest period q and at least ``POWER`` periods and ``LEAST``
words that cannot be made longer. For each period p the grid of places 0, p, 2p, ... meets every
run of period p at three neighbouring places at least, so it is enough to extend neighbouring grid
places to both sides: n / p extensions for a period, n log n in all.

The extensions come from a difference cover: of the suffixes only those at places whose remainder
lies in the cover are sorted (by their first words, then by doubling among themselves). Any two
places reach covered places together within ``MODULUS`` words; these few are compared directly and
the rest is a range minimum over the common prefixes of neighbours in sorted order, read from a
sparse table. A second cover over the reversed words extends to the left.

Documents are joined into one array of word numbers for a slice of a batch; extensions end with
their document. Grid places whose next ``GRAM`` words differ cannot lie in a run and fall out first;
the covers hold only the documents that are left. Texts never leave their task: no shuffle.

Defined results: a null, empty or blank text has no words and no runs; ties in length / period go
to the smaller start, then period; repeated rows give a row each; a row without an id is not edited
by ``edit_words``; a text of any length is taken whole, in memory of some hundred bytes a word;
extra columns, whatever their names, are left aside; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import mixed, text_slices, word_codes

LEAST = 24
POWER = 3
# A perfect difference set: each remainder but 0 is the difference of exactly one pair.
MODULUS = 31
COVER = np.array([1, 5, 11, 24, 25, 27])
# Words at both places of a grid pair that must agree before it is extended.
GRAM = 8
# Grid pairs that are extended at once.
PAIRS = 2_000_000

_IN_COVER = np.isin(np.arange(MODULUS), COVER)
# Words from two remainders to the first two covered places at the same distance.
_SHIFT = np.array(
    [[next(d for d in range(MODULUS) if _IN_COVER[(a + d) % MODULUS] and _IN_COVER[(b + d) % MODULUS]) for b in range(MODULUS)] for a in range(MODULUS)]
)


class Extensions:
    """Length of the longest common extension of two different places of an array of numbers from 0 on."""

    def __init__(self, codes: np.ndarray):
        n = self.size = len(codes)
        self.words = np.concatenate([codes.astype(np.int64) + 1, np.zeros(2 * MODULUS, np.int64)])
        places = np.flatnonzero(_IN_COVER[np.arange(n) % MODULUS])
        self.index = np.zeros(n + 1, np.int64)
        self.index[places] = np.arange(len(places))
        count = len(places)
        ranks = [self._first_ranks(places)] if count else [np.zeros(0, np.int64)]
        step = MODULUS
        while count and ranks[-1].max() < count - 1:
            after = places + step
            following = np.where(after < n, ranks[-1][self.index[np.minimum(after, n)]] + 1, 0)
            _, doubled = np.unique(ranks[-1] * (count + 1) + following, return_inverse=True)
            ranks.append(doubled)
            step *= 2
        self.rank = ranks[-1]
        order = places[np.argsort(self.rank)]
        self.table = self._minima(self._neighbours(order[:-1], order[1:], ranks))

    def _first_ranks(self, places: np.ndarray) -> np.ndarray:
        """Dense ranks of the covered suffixes by their first ``MODULUS`` words, several to a sort key."""
        bits = max(1, int(self.words.max()).bit_length())
        each = max(1, 63 // bits)
        keys = []
        for first in range(0, MODULUS, each):
            key = np.zeros(len(places), np.int64)
            for place in range(first, min(MODULUS, first + each)):
                key = (key << bits) | self.words[places + place]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        changed = np.zeros(len(places), bool)
        for key in keys:
            changed[1:] |= key[order[1:]] != key[order[:-1]]
        ranks = np.empty(len(places), np.int64)
        ranks[order] = np.cumsum(changed)
        return ranks

    def _neighbours(self, a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """Common prefixes of suffixes next to each other: whole blocks by equal ranks, then words."""
        length = np.zeros(len(a), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            x, y = a + length, b + length
            inside = np.maximum(x, y) < self.size
            x, y = np.where(inside, x, 0), np.where(inside, y, 0)
            same = inside & (ranks[level][self.index[x]] == ranks[level][self.index[y]])
            length += np.where(same, MODULUS << level, 0)
        return length + self._words(a + length, b + length, np.full(len(a), MODULUS))

    @staticmethod
    def _minima(values: np.ndarray) -> list[np.ndarray]:
        table = [values]
        while 2 << (len(table) - 1) <= len(values):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def _words(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from both places on, up to ``most``, compared one after another."""
        found = np.zeros(len(a), np.int64)
        active = np.flatnonzero(most > 0)
        for place in range(MODULUS):
            left, right = self.words[a[active] + place], self.words[b[active] + place]
            active = active[(left == right) & (left > 0)]
            found[active] = place + 1
            active = active[most[active] > place + 1]
            if not len(active):
                break
        return found

    def extend(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shift = _SHIFT[a % MODULUS, b % MODULUS]
        found = self._words(a, b, shift)
        far = np.flatnonzero((found == shift) & (np.maximum(a, b) + shift < self.size))
        x, y = self.rank[self.index[a[far] + shift[far]]], self.rank[self.index[b[far] + shift[far]]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        least = np.zeros(len(far), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.table[k]
            least[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        found[far] += least
        return found


def _grams(codes: np.ndarray, words: int) -> np.ndarray:
    """32 bits of a hash of the next ``words`` words (a power of two) at each place."""
    value, reach = mixed(codes.astype(np.uint64) + np.uint64(1)), 1
    while reach < words:
        value = mixed(value)
        value[:-reach] += value[reach:] * np.uint64(2 * reach + 1)
        reach *= 2
    return mixed(value).astype(np.uint32)


def _gram_words(least: int, power: int) -> int:
    """How many words behind the first grid pair of any run agree for sure, as a power of two up to ``GRAM``."""
    sure = min(max(least - 2 * q, (power - 2) * q) + 1 for q in range(1, least + 1))
    return min(GRAM, 1 << (sure.bit_length() - 1))


def find_runs(codes: np.ndarray, offsets: np.ndarray, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, ...]:
    """Document, start, length and period of all runs, by document, start and period.

    ``codes`` are the word numbers of all documents, ``offsets`` where each one begins; starts count
    from the first word of the array. ``power`` is 3 at least.
    """
    if power < 3:
        raise ValueError("a run has three periods at least")
    sizes = np.diff(offsets)
    longest = int(sizes.max()) if len(sizes) else 0
    empty = tuple(np.zeros(0, np.int64) for _ in range(4))
    if longest < max(least, power):
        return empty
    owner = np.repeat(np.arange(len(sizes)), sizes)
    grams = _grams(codes, _gram_words(least, power))
    covers = None
    held, kept, found = [], 0, []

    def extend(chosen: np.ndarray) -> None:
        """Candidate runs of the grid pairs held so far, by covers over the chosen documents."""
        nonlocal covers
        a = np.concatenate([x for x, _ in held])
        p = np.concatenate([np.full(len(x), q) for x, q in held])
        if covers is None:
            part = codes[chosen[owner]]
            moved = np.concatenate([[0], np.cumsum(np.where(chosen, sizes, 0))])
            covers = Extensions(part), Extensions(part[::-1]), moved
        forward, backward, moved = covers
        doc = owner[a]
        x = a - offsets[doc] + moved[doc]
        right = np.minimum(forward.extend(x, x + p), moved[doc + 1] - x - p)
        left = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(x > moved[doc])
        left[inner] = backward.extend(backward.size - x[inner], backward.size - x[inner] - p[inner])
        left = np.minimum(left, x - moved[doc])
        length = left + p + right
        good = np.flatnonzero(length >= np.maximum(least, power * p))
        found.append((doc[good], a[good] - left[good], length[good], p[good]))

    for period in range(1, longest // power + 1):
        row = grams[::period]
        hit = np.flatnonzero(row[1:] == row[:-1])
        if len(hit):
            hit = hit * period
            hit = hit[owner[hit] == owner[hit + period]]
            if len(hit):
                held.append((hit, period))
                kept += len(hit)
                if kept >= PAIRS:
                    extend(np.ones(len(sizes), bool))
                    held, kept = [], 0
    if held:
        chosen = np.zeros(len(sizes), bool)
        chosen[np.unique(np.concatenate([owner[x] for x, _ in held]))] = True
        extend(chosen)
    if not found:
        return empty
    doc, start, length, period = (np.concatenate(x) for x in zip(*found))
    # Multiples of the smallest period give the same stretch.
    order = np.lexsort([period, length, start])
    doc, start, length, period = doc[order], start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    doc, start, length, period = doc[first], start[first], length[first], period[first]
    order = np.lexsort([period, start])
    return doc[order], start[order], length[order], period[order]


def edit_words(codes: np.ndarray, offsets: np.ndarray, ids: list[int | None]) -> np.ndarray:
    """The words with the stated edit: in one document of ten, by its id's checksum, the tail becomes periodic."""
    place = None
    for number, doc_id in enumerate(ids):
        first, n = int(offsets[number]), int(offsets[number + 1] - offsets[number])
        if doc_id is None or not n:
            continue
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            period = 1 + (n - a) // (3 + g % 8)
            if place is None:
                place = np.arange(len(codes))
            place[first + a : first + n] = first + a + np.arange(n - a) % period
    return codes if place is None else codes[place]


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)
_NOTHING = hashlib.sha256(b"").hexdigest()


def repeated_runs(documents: DataFrame, edit: bool = False, least: int = LEAST, power: int = POWER) -> DataFrame:
    """For each document its runs, the one of greatest length / period, and the words left once each run is cut to its first period.

    A word goes if any run holds it after that run's first period. ``edit`` puts ``edit_words`` before.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            offsets, codes, dictionary = word_codes(batch.column(1))
            if edit:
                codes = edit_words(codes, offsets, batch.column(0).to_pylist())
            doc, start, length, period = find_runs(codes, offsets, least, power)
            count = np.bincount(doc, minlength=len(batch))
            best = [[None] * len(batch) for _ in range(4)]
            digest = [_NOTHING] * len(batch)
            ends = np.cumsum(count)
            local = start - offsets[doc]
            for number in np.flatnonzero(count).tolist():
                part = slice(int(ends[number] - count[number]), int(ends[number]))
                rows = list(zip(local[part].tolist(), length[part].tolist(), period[part].tolist()))
                # Two different quotients of numbers below 2^31 differ by more than 2^-62.
                top = max(rows, key=lambda r: ((r[1] << 64) // r[2], -r[0], -r[2]))
                for column, value in zip(best, (*top, 1000 * top[1] // top[2])):
                    column[number] = value
                digest[number] = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in rows).encode()).hexdigest()
            gone = np.zeros(len(codes) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, start + length, -1)
            stays = np.cumsum(gone)[:-1] == 0
            left = np.concatenate([[0], np.cumsum(stays)])[offsets]
            words = pa.ListArray.from_arrays(pa.array(left, pa.int32()), dictionary.take(pa.array(codes[stays])))
            texts = pc.binary_join(words, " ").cast(pa.binary()).to_pylist()
            collapsed = [hashlib.sha256(text).hexdigest() for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), *[pa.array(c, pa.int64()) for c in best], pa.array(digest), pa.array(collapsed)],
                names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, SCHEMA)
