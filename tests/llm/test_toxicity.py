"""Toxicity: the automaton against edit distances, held-out accuracy, odd rows."""

import random
import zlib

from cases import LABELS, clashing, document, frame, odd_documents, words

from knotwork.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = {"idiot": 3.0, "idiots": 2.0, "scum": 4.0, "clown": 5.0, "clone": 1.0, "worthless": 6.0}
    lexicon = toxicity.Lexicon(terms, {"lowei": 9.0})
    picker = random.Random(0)
    probes = list(terms) + ["", "i", "loweix", "lowei", "lowe", "xlowei"]
    for term in terms:
        for _ in range(300):
            letters = list(term)
            for _ in range(picker.randrange(1, 3)):
                place = picker.randrange(len(letters) + 1)
                action = picker.randrange(3)
                if action == 0:
                    letters.insert(place, picker.choice("abcdeilnostw"))
                elif place < len(letters):
                    letters[place : place + 1] = picker.choice("abcdeilnostw") if action == 1 else ""
            probes.append("".join(letters))
    for probe in probes:
        if probe.startswith("lowei"):
            wanted = (9.0, 0)
        elif probe in terms:
            wanted = (terms[probe], 0)
        else:
            near = [w for t, w in terms.items() if len(t) >= 5 and probe[:1] == t[:1] and distance(probe, t) == 1 and distance(probe[1:], t[1:]) == 1]
            wanted = (max(near), 1) if near else None
        assert lexicon.match(probe) == wanted, probe


def corpus(count=900):
    insults = ["zimble", "krattok", "vuxen", "plorg", "skwernt"]
    rows, labels = [], []
    for i in range(count):
        text = words(i, 30 + i % 50)
        toxic = i % 4 == 0
        if toxic:
            picker = random.Random(i)
            for _ in range(3):
                term = picker.choice(insults)
                text.insert(picker.randrange(len(text)), term.upper() + "!" if i % 8 else term)
        rows.append(document(i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_rows(spark):
    rows, labels = corpus()
    rows.append(document(5000, " ".join(words(5, 20) + ["zimbel", "kratok", "skwermt"] + words(6, 20))))
    found = {r.doc_id: r for r in toxicity.score_toxicity(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    for doc_id, _, toxic in labels:
        row = found[doc_id]
        assert row.held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert row.predicted == toxic == int(row.score >= 0.5)
    assert found[5000].score > min(r.score for r in found.values())


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(400)
    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    scores = [
        {r.doc_id: r.score for r in toxicity.score_toxicity(frame(spark, rows), spark.createDataFrame(x, LABELS)).collect()}
        for x in (labels, turned)
    ]
    assert scores[0] == scores[1]


def test_context_separates_quotation():
    plain = "what a zimble thing to do here now".split()
    quoted = "he said the word “zimble” in a report".split()
    address = "you are such a zimble my friend".split()
    at = [next(i for i, w in enumerate(x) if "zimble" in w) for x in (plain, quoted, address)]
    assert toxicity._context(quoted, at[1]) < toxicity._context(plain, at[0]) < toxicity._context(address, at[2])


def test_odd_rows_and_columns(spark):
    docs = clashing(frame(spark, odd_documents()))
    labels = spark.createDataFrame([(6, 1, 1), (9, 1, 0), (None, 1, 1), (4, 1, None), (6, 1, 1)], LABELS)
    found = toxicity.score_toxicity(docs, labels).collect()
    assert len(found) == len(odd_documents()) and all(0 <= r.score <= 1 for r in found)
    none = spark.createDataFrame([], LABELS)
    assert {r.predicted for r in toxicity.score_toxicity(docs, none).collect()} == {0}
    assert toxicity.keep_clean(docs, none).columns == docs.columns
    assert toxicity.score_toxicity(frame(spark, []), labels).count() == 0
