"""Best-fit packing of tokenised documents into sequences of fixed length.

Documents become token ids in their own partitions (no shuffle of texts); only pieces as triples of
numbers go on. Pieces are dealt by a hash to shards of about ``SHARD_PIECES``; each shard is packed
by best-fit decreasing with a segment tree over remaining capacities, so a piece finds the tightest
open sequence in logarithmic time. A shard wastes less than one sequence on its last open ones,
which bounds the loss against one global packing by 1 in several thousand sequences.

Defined results: a null or empty text is the closing id alone; ties in length go by doc_id and
piece; repeated rows are packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import text_slices, word_codes
from knotwork.session import cut

SEQUENCE_TOKENS = 4096
END_ID = 1
# Pieces that one task packs; about 4,000 sequences.
SHARD_PIECES = 16_384
# Text that is encoded at once: many repeated words, and ids that fit into some tens of megabytes.
SLICE_BYTES = 4_000_000
# Entries of a worker's memories of encoded runs of letters and other chunks; those not met for longest are forgotten.
KNOWN_RUNS = 400_000
KNOWN_CHUNKS = 60_000
# Longer chunks go to the full tokenizer.
LONG_CHUNK = 48
PUNCTUATION = ".,;:!?"
LETTERS = "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7))
PLAIN = f"^[{LETTERS}]+[{PUNCTUATION}]*$"


def _ids(tokenizer, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text, a few texts at a time: what the tokenizer gives back is many times larger than the ids."""
    out: list[np.ndarray] = []
    for start in range(0, len(texts), 64):
        found = tokenizer.encode_batch_fast(texts[start : start + 64], add_special_tokens=False)
        out += [np.array(e.ids, dtype="<u4") for e in found]
    return out


class Memory:
    """Ids by text in two halves; when the younger half is full, the older one is forgotten.

    A half holds more than its share only where one slice of text has more.
    """

    def __init__(self, most: int):
        self.half = max(1, most // 2)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def recall(self, texts: list[str]) -> list[bytes | None]:
        """Ids of each text, None where it is not known."""
        found = list(map(self.young.get, texts))
        old, again = self.old, {}
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = ids = old.get(texts[i])
                if ids is not None:
                    again[texts[i]] = ids
        self.keep(again)
        return found

    def keep(self, new: dict[str, bytes]) -> None:
        if len(self.young) + len(new) > self.half:
            self.old, self.young = self.young, {}
        self.young.update(new)


class WordEncoder:
    """Token ids as little-endian bytes, remembered for runs of letters and for other chunks.

    The vocabulary drops white space and never joins across it, so the ids of a text are the ids
    of its chunks in order. Chunks of Latin-1 letters with plain punctuation behind them are cut
    into these two runs, which meet the same vocabulary in a tokenizer without normalisation; all
    other chunks go to the full tokenizer as they are.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        ends = np.zeros(max(parts["model"]["vocab"].values()) + 1, dtype=bool)
        ends[[i for token, i in parts["model"]["vocab"].items() if token.endswith("</w>")]] = True
        self.ends = ends
        parts |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(parts))
        self.runs = Memory(KNOWN_RUNS)
        self.chunks = Memory(KNOWN_CHUNKS)
        # A byte-level vocabulary writes bytes A1-AC and AE-FF as themselves and the rest of 80-FF from U+0122 on.
        other = [c for c in range(0x7F, 0xA1)] + [0xAD]
        shown = {c: chr(0x121 + i) for i, c in enumerate(other)}
        self.as_bytes = {
            c: "".join(shown.get(x, chr(x)) for x in chr(c).encode()) for c in range(0xC0, 0x100)
        }

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        return [ids.tobytes() for ids in _ids(self.tokenizer, chunks)]

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        if not runs:
            return []
        lines = [" ".join(runs[i : i + 20]).translate(self.as_bytes) for i in range(0, len(runs), 20)]
        ids = np.concatenate(_ids(self.bare, lines))
        cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    @staticmethod
    def _recalled(memory: Memory, pieces: pa.Array, encode) -> list[bytes]:
        """Ids of distinct pieces: those in the memory, and the others encoded now."""
        texts = pieces.to_numpy(zero_copy_only=False).tolist()
        spelled = memory.recall(texts)
        missing = [i for i, ids in enumerate(spelled) if ids is None]
        new = encode([texts[i] for i in missing])
        for i, ids in zip(missing, new):
            spelled[i] = ids
        memory.keep({texts[i]: ids for i, ids in zip(missing, new)})
        return spelled

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin and end."""
        offsets, codes, chunks = word_codes(texts)
        plain = pc.and_(pc.less_equal(pc.utf8_length(chunks), LONG_CHUNK), pc.match_substring_regex(chunks, PLAIN))
        plain = np.asarray(plain, dtype=bool)
        simple = chunks.filter(pa.array(plain))
        # Letters of Latin-1 have one-to-one lower case and nothing to compose.
        words = pc.dictionary_encode(pc.utf8_lower(pc.utf8_rtrim(simple, characters=PUNCTUATION)))
        marks = pc.dictionary_encode(pc.utf8_ltrim(simple, characters=LETTERS))
        spelled = self._recalled(self.runs, words.dictionary, self._encode_runs)
        spelled += [self._encode_runs([mark])[0] if mark else b"" for mark in marks.dictionary.to_pylist()]
        spelled += self._recalled(self.chunks, chunks.filter(pa.array(~plain)), self._encode_chunks)
        spelled.append(b"")
        # Each chunk is two pieces, of which the second may be empty.
        pair = np.full((len(chunks), 2), len(spelled) - 1, dtype=np.int32)
        pair[plain, 0] = np.asarray(words.indices)
        pair[plain, 1] = np.asarray(marks.indices) + len(words.dictionary)
        pair[~plain, 0] = len(words.dictionary) + len(marks.dictionary) + np.arange(len(chunks) - len(simple))
        sizes = np.fromiter(map(len, spelled), dtype=np.int32, count=len(spelled)) // 4
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        pool = np.frombuffer(b"".join(spelled), dtype="<u4")
        # Ids of each distinct chunk in one place, then of each chunk of the texts.
        pool, ends = _laid_out(pool, starts, sizes, pair.ravel())
        ends = ends[::2]
        ids, ends = _laid_out(pool, ends[:-1], np.diff(ends), codes)
        return ids, ends[offsets]


def _laid_out(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``pool`` that the codes stand for, one after another, and where each begins and the last ends."""
    counts = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int32)]).astype(np.int32)
    at = np.arange(ends[-1], dtype=np.int32) + np.repeat(starts[codes] - ends[:-1], counts)
    return pool[at], ends


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, so that its memory lasts over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids, cut where they exceed ``capacity``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        closing = np.array([END_ID], dtype="<u4").tobytes()
        for batch in text_slices(batches, most=SLICE_BYTES):
            place, piece, start, length, crc = [], [], [], [], []
            ids, ends = own.encode(batch.column(1))
            raw = memoryview(ids.tobytes())
            for i, (first, last) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                for number, low in enumerate(range(first, last + 1, capacity)):
                    high = min(low + capacity, last)
                    code = zlib.crc32(raw[4 * low : 4 * high])
                    if high < low + capacity:  # the closing id comes last
                        code = zlib.crc32(closing, code)
                        high += 1
                    place.append(i)
                    piece.append(number)
                    start.append(low - first)
                    length.append(high - low)
                    crc.append(code)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(place, pa.int32())),
                    pa.array(piece, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


class OpenSequences:
    """Open sequences by remaining capacity, with a segment tree of which capacities occur.

    A leaf stands for one remaining capacity and holds its sequences; an inner node tells whether
    any leaf below it holds one.
    """

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def tightest(self, length: int) -> int:
        """The least remaining capacity of at least ``length`` that occurs, or -1."""
        node, any_ = self.width + length, self.any
        if any_[node]:
            return length
        while node > 1:
            if not node & 1 and any_[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if any_[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return -1

    def put(self, remaining: int, sequence: int) -> None:
        self.open[remaining].append(sequence)
        node = self.width + remaining
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, remaining: int) -> int:
        sequence = self.open[remaining].pop()
        if not self.open[remaining]:
            node, any_ = self.width + remaining, self.any
            any_[node] = 0
            node >>= 1
            while node and not (any_[2 * node] or any_[2 * node + 1]):
                any_[node] = 0
                node >>= 1
        return sequence


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each length; the lengths come in falling order."""
    bins, count, sequence, offset = OpenSequences(capacity), 0, [], []
    for length in lengths:
        remaining = bins.tightest(length)
        if remaining < 0:
            chosen, remaining = count, capacity
            count += 1
        else:
            chosen = bins.take(remaining)
        sequence.append(chosen)
        offset.append(capacity - remaining)
        if remaining > length:
            bins.put(remaining - length, chosen)
    return sequence, offset


def pack(parts: DataFrame, capacity: int = SEQUENCE_TOKENS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``parts`` (doc_id, piece, length and more) with ``sequence_id`` and ``offset``."""
    parts = cut(parts)
    shards = max(1, -(-parts.count() // shard_pieces))
    schema = parts.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def work(rows: pa.Table) -> pa.Table:
        number = rows.column("_shard")[0].as_py()
        rows = rows.drop_columns("_shard").sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset = best_fit(rows.column("length").to_pylist(), capacity)
        rows = rows.append_column("sequence_id", pa.array(np.array(sequence, dtype=np.int64) * shards + number))
        return rows.append_column("offset", pa.array(offset, pa.int64()))

    # Equal rows are told apart by their place in the written table, so that copies spread over the shards.
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id(), *parts.columns), F.lit(shards)).alias("_shard")
    return parts.select("*", shard).groupBy("_shard").applyInArrow(work, schema)


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """One row for each piece of ``documents`` (doc_id, text): where it lies and what it holds."""
    return pack(pieces(documents, tokenizer_path, capacity), capacity)
