"""Toxicity from a learnt lexicon, matched by Levenshtein automata and weighed by context.

1. Words and word stems whose labelled documents are mostly toxic form the lexicon. Support is
   counted over groups of near copies (by the least shingle hash), so that a copied document does
   not vouch for its own rare words.
2. The lexicon is a trie; it is intersected with a Levenshtein automaton of distance 1, and the
   product is made deterministic state by state as words ask for it. Most words leave it after a
   few letters. Words of five letters and more may be misspelled after their first letter.
3. Each hit is weighed by its window: quotation marks and words of reporting lower it, words that
   address a person raise it. A logistic model turns a document's hits into a score.

Labels come from a seeded sample of at most ``LABELLED_DOCUMENTS`` rows and never from held-out
rows (crc32 of the id as text divisible by 5). The lexicon holds every word, stem and near miss of theirs
that passes the limits on groups and odds, so it is bounded by the labelled sample and not by the corpus.
Scoring is one pass over the texts without a shuffle. Labels, language, source and id are no input
of a score.

Defined results: null, empty and blank texts have no hits and get the score of a text without
hits; equal texts get equal scores; a null id is never held out; without toxic labels every score
is 0; extra columns stay in ``keep_clean``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import bounded_labels, shingle_sets, text_slices, word_codes, without
from knotwork.session import cut

LABELLED_DOCUMENTS = 20_000
SEED = 9
# Groups of toxic documents that must hold a term, and least log odds of a term.
LEAST_GROUPS = 4
LEAST_ODDS = 3.0
STEM_LETTERS = (4, 5, 6)
STEM_WORDS = 5
STEM_GROUPS = 12
FUZZY_LETTERS = 5
# What a misspelling that no labelled document shows keeps of its term's weight.
FUZZY_SHARE = 0.7
WINDOW = 6
FEATURES = 4

# Cues of quotation and of address.
QUOTES = "\"'“”„«»‘’"
REPORTING = {"said", "says", "wrote", "quote", "quoted", "quoting", "called", "calling", "word", "words", "term", "insult", "insults", "slur", "reported", "report"}
ADDRESS = {"you", "your", "you're", "u", "ur", "yourself"}
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”„«»‘’…¡¿"


class Lexicon:
    """Product of the lexicon trie and a Levenshtein automaton, made deterministic on demand.

    Words match at distance 0 or 1, stems match the beginning of a word at distance 0.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.word_weight: list[float | None] = [None]
        self.stem_weight: list[float | None] = [None]
        self.letters: list[int] = [0]
        for term, weight, ends in [*((t, w, self.word_weight) for t, w in words.items()), *((t, w, self.stem_weight) for t, w in stems.items())]:
            node = 0
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.word_weight.append(None)
                    self.stem_weight.append(None)
                    self.letters.append(self.letters[node] + 1)
                node = self.children[node][letter]
            ends[node] = weight
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[float, int] | None] = []
        self.begins: list[float | None] = []
        self.dead = self._state(frozenset())
        self.start = self._state(frozenset([(0, 0)]))

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.numbers:
            self.numbers[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.steps.append({})
            self.begins.append(max((self.stem_weight[n] for n, e in pairs if not e and self.stem_weight[n] is not None), default=None))
            self.ends.append(self._end(pairs))
        return self.numbers[pairs]

    def _end(self, pairs: frozenset) -> tuple[float, int] | None:
        exact = [self.word_weight[n] for n, e in pairs if not e and self.word_weight[n] is not None]
        if exact:
            return max(exact), 0
        near = [n for n, e in pairs if e] + [c for n, e in pairs if not e for c in self.children[n].values()]
        near = [self.word_weight[n] for n in near if self.word_weight[n] is not None and self.letters[n] >= FUZZY_LETTERS]
        return (max(near), 1) if near else None

    def _step(self, state: int, letter: str) -> int:
        out = set()
        for node, edits in self.sets[state]:
            children = self.children[node]
            if letter in children:
                out.add((children[letter], edits))
            if not edits and node:
                out.add((node, 1))
                for other, child in children.items():
                    if other != letter:
                        out.add((child, 1))
                    if letter in self.children[child]:
                        out.add((self.children[child][letter], 1))
        # A pair with an edit adds nothing to the same node without one.
        pairs = frozenset((n, e) for n, e in out if not e or (n, 0) not in out)
        return self._state(pairs)

    def match(self, word: str) -> tuple[float, int] | None:
        """Weight and distance of the best term, or None."""
        state, steps, begins = self.start, self.steps, self.begins
        best = None
        for letter in word:
            after = steps[state].get(letter)
            if after is None:
                after = steps[state][letter] = self._step(state, letter)
            if after == self.dead:
                return None if best is None else (best, 0)
            state = after
            if begins[state] is not None:
                best = max(begins[state], best or begins[state])
        end = self.ends[state]
        if best is not None and (end is None or end[1] or best >= end[0]):
            return best, 0
        return end


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _normal(words: Iterable[str]) -> list[str]:
    return [w.strip(EDGE) for w in words]


def _labelled_words(rows: DataFrame) -> DataFrame:
    """word, copies (group of near copies), toxic: the distinct words of each labelled text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            values, at = shingle_sets(batch.column(0))
            least = [int(values[a].astype(np.int64)) if b > a else 0 for a, b in zip(at[:-1], at[1:])]
            offsets, codes, dictionary = word_codes(pc.utf8_lower(pc.fill_null(batch.column(0), "")))
            normal = np.array(_normal(dictionary.to_pylist()), dtype=object)
            own = [np.unique(codes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            counts = [len(x) for x in own]
            words = normal[np.concatenate(own)] if own else np.array([], dtype=object)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(words, pa.string()),
                    pa.array(np.repeat(np.array(least, dtype=np.int64), counts)),
                    pa.array(np.repeat(np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=np.int32), counts)),
                ],
                names=["word", "copies", "toxic"],
            )

    return rows.select("text", "_label").mapInArrow(work, "word string, copies long, toxic int")


def learn_lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """Words and stems with their log odds, and the log odds of known near misses, from ``rows`` (text, _label)."""
    groups = _labelled_words(rows).filter("word <> ''").groupBy("word", "copies").agg(F.max("toxic").alias("toxic"))
    counted = cut(groups.groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")))
    totals = groups.groupBy("copies").agg(F.max("toxic").alias("toxic")).agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    bad, good = (totals[0] or 0), (totals[1] or 0)
    if not bad:
        return {}, {}, {}

    def odds(pos: float, neg: float) -> float:
        return math.log((pos + 0.5) / (bad + 1)) - math.log((neg + 0.5) / (good + 1))

    often = counted.filter((F.col("pos") >= LEAST_GROUPS) & (F.col("neg") <= F.col("pos") * 0.05))
    words = {r["word"]: odds(r["pos"], r["neg"]) for r in often.orderBy(F.desc("pos"), "word").collect()}
    letters = F.explode(F.array(*[F.lit(n) for n in STEM_LETTERS]))
    prefixes = counted.withColumn("n", letters).filter(F.length("word") > F.col("n"))
    stems_counted = prefixes.groupBy(F.expr("substring(word, 1, n)").alias("stem")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count(F.when(F.col("pos") > 0, 1)).alias("words")
    )
    clear = (F.col("pos") >= STEM_GROUPS) & (F.col("words") >= STEM_WORDS) & (F.col("neg") <= F.col("pos") * 0.02)
    stems: dict[str, float] = {}
    for r in sorted(stems_counted.filter(clear).orderBy(F.desc("pos"), "stem").collect(), key=lambda r: len(r["stem"])):
        if not any(r["stem"][:n] in stems for n in STEM_LETTERS):
            stems[r["stem"]] = odds(r["pos"], r["neg"])
    words = {w: o for w, o in words.items() if o >= LEAST_ODDS}
    stems = {s: o for s, o in stems.items() if o >= LEAST_ODDS}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(words, stems)
        for batch in batches:
            hits = [lexicon.match(w) for w in batch.column(0).to_pylist()]
            yield batch.filter(pa.array([h is not None and h[1] == 1 for h in hits], pa.bool_()))

    misses = counted.mapInArrow(near, counted.schema)
    return words, stems, {r["word"]: odds(r["pos"], r["neg"]) for r in misses.collect()}


def _context(words: list[str], at: int) -> float:
    """Below 1 for a hit that is quoted or reported, above 1 where a person is addressed."""
    factor = 1.0
    before, after = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
    opened = words[at][:1] in QUOTES or any(w[:1] in QUOTES and w[-1:] not in QUOTES for w in before)
    closed = words[at].rstrip(".,;:!?")[-1:] in QUOTES or any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in after)
    if opened and closed:
        factor *= 0.4
    near = {w.strip(EDGE) for w in [*before, *after]}
    if near & REPORTING:
        factor *= 0.6
    if near & ADDRESS:
        factor *= 1.25
    return factor


def hit_features(rows: DataFrame, words: dict[str, float], stems: dict[str, float], misses: dict[str, float]) -> DataFrame:
    """doc_id, _label, features of the hits of each text: best, sum, share of words, number."""
    shared = rows.sparkSession.sparkContext.broadcast((words, stems, misses))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_words, own_stems, own_misses = shared.value
        lexicon = Lexicon(own_words, own_stems)

        def weight(word: str) -> float:
            found = lexicon.match(word)
            if found is None:
                return 0.0
            if found[1] == 0:
                return found[0]
            return max(0.0, own_misses.get(word, FUZZY_SHARE * found[0]))

        for batch in text_slices(batches):
            offsets, codes, dictionary = word_codes(pc.utf8_lower(pc.fill_null(batch.column(1), "")))
            raw = dictionary.to_numpy(zero_copy_only=False)
            weights = np.fromiter(map(weight, _normal(raw)), dtype=np.float64, count=len(raw))
            out = np.zeros((len(batch), FEATURES))
            places = np.flatnonzero(weights[codes] > 0) if len(codes) else np.zeros(0, np.int64)
            owners = np.searchsorted(offsets, places, side="right") - 1
            for place, owner in zip(places.tolist(), owners.tolist()):
                low, high = max(offsets[owner], place - WINDOW), min(offsets[owner + 1], place + WINDOW + 1)
                value = weights[codes[place]] * _context(raw[codes[low:high]].tolist(), place - low)
                row = out[owner]
                row[0] = max(row[0], value)
                row[1] += value
                row[3] += 1
            out[:, 2] = np.sqrt(out[:, 3] / np.maximum(np.diff(offsets), 1))
            out[:, 1], out[:, 3] = np.log1p(out[:, 1]), np.log1p(out[:, 3])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *[pa.array(np.ascontiguousarray(out[:, i])) for i in range(FEATURES)]],
                names=["doc_id", "_label", *[f"f{i}" for i in range(FEATURES)]],
            )

    fields = ", ".join(f"f{i} double" for i in range(FEATURES))
    return rows.select("doc_id", "text", "_label").mapInArrow(work, f"doc_id long, _label int, {fields}")


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Intercept and weights by Newton steps with a ridge penalty on the weights."""
    x = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([1e-6, *[penalty] * (x.shape[1] - 1)])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - ridge @ beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, gradient)
        beta += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score_toxicity(documents: DataFrame, labels: DataFrame, most_labels: int = LABELLED_DOCUMENTS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents`` (doc_id, text)."""
    known = bounded_labels(labels.filter(~held_out(F.col("doc_id"))), "toxic", most_labels, SEED)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.join(F.broadcast(known), F.col("doc_id") == F.col("_label_doc"), "left")
    words, stems, misses = learn_lexicon(rows.filter("_label IS NOT NULL"))
    found = cut(hit_features(rows, words, stems, misses))
    names = [f"f{i}" for i in range(FEATURES)]
    fitted = found.filter("_label IS NOT NULL").select(*names, "_label").toPandas()
    y = fitted["_label"].to_numpy(dtype=float)
    if len(y) and 0 < y.sum() < len(y):
        beta = fit_logistic(fitted[names].to_numpy(), y)
    else:
        beta = np.array([30.0 if y.sum() else -1000.0] + [0.0] * FEATURES)
    logit = F.lit(float(beta[0]))
    for name, weight in zip(names, beta[1:]):
        logit = logit + F.col(name) * F.lit(float(weight))
    score = 1 / (1 + F.exp(-logit))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def keep_clean(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that are not predicted toxic, with all their columns."""
    return without(documents, score_toxicity(documents, labels, **options).filter("predicted = 1"))
