"""License scan on a small tree of files."""

from knotwork.llm import licenses

SCHEMA = "doc_id long, path string, text string, license string, terms int"


def scan(spark, rows):
    table = spark.createDataFrame([(i, p, t, "clash", 1) for i, (p, t) in enumerate(rows)], SCHEMA)
    found = licenses.scan(table, "doc_id").collect()
    assert len(found) == len(rows)
    return {r.doc_id: (r.license, r.origin, r.license_path) for r in found}


MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."


def test_headers_and_inheritance(spark):
    rows = [
        ("/a/LICENSE", MIT),
        ("/a/x.py", "code"),
        ("/a/b/c/y.py", "more code"),
        ("/a/b/z.py", "first\n# " + GPL + "\nrest " * 20_000),
        ("/a/d/COPYING.txt", GPL + "\n" + MIT),
        ("/a/d/e/w.py", "the licensed plumber came"),
        ("/f/u.py", None),
        (None, "nothing"),
        ("/f/v.py", ""),
        ("/ab/t.py", "x"),
    ]
    found = scan(spark, rows)
    assert found == {
        0: ("MIT", "header", "/a/LICENSE"),
        1: ("MIT", "inherited", "/a/LICENSE"),
        2: ("MIT", "inherited", "/a/LICENSE"),
        3: ("GPL-3.0", "header", "/a/b/z.py"),
        4: ("GPL-3.0", "header", "/a/d/COPYING.txt"),
        5: ("GPL-3.0", "inherited", "/a/d/COPYING.txt"),
        6: (None, "none", None),
        7: (None, "none", None),
        8: (None, "none", None),
        9: (None, "none", None),
    }


def test_every_template_names_its_license(spark):
    found = scan(spark, [(f"/x/{i}", text) for i, (_, text) in enumerate(licenses.TEMPLATES)])
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        if licenses.re.search(licenses.HEADER, text):
            assert found[i][0] == name


def test_ties_repeated_rows_and_root(spark):
    rows = [("/LICENSE", GPL), ("/LICENSE", GPL), ("/LICENSE.b", MIT), ("/p/q", "x"), ("/p/q", "x")]
    found = scan(spark, rows)
    assert found[3] == found[4] == ("GPL-3.0", "inherited", "/LICENSE")


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA), "doc_id").count() == 0


PREFIXED = [
    ("Copyright 2021 Example Corp. Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("This file is part of Frobnicator and is licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Copyright (c) 2019 Jane Doe. Released under the MIT License.", "MIT"),
    ("word " * 500 + "Copyright 2020 Some Authors. Released under the BSD 3-Clause License. " + "more " * 500, "BSD-3-Clause"),
    ("# Copyright 2020 Some Authors.\n# Licensed under the Apache License,\n# Version 2.0.\ncode", "Apache-2.0"),
    ("Copyright (c) 2018 The Frobnicator Project and its many contributors", None),
    ("the licensed plumber came to see about the tap", None),
]


def test_notices_behind_other_words(spark):
    found = scan(spark, [(f"/{i}/x.py", text) for i, (text, _) in enumerate(PREFIXED)])
    assert [found[i][0] for i in range(len(PREFIXED))] == [wanted for _, wanted in PREFIXED]


def test_whole_licence_files(spark):
    texts = licenses.license_texts()
    named = [(f"/{i}/LICENSE", text.replace("year holder", "2001-2024 Jane Doe, John Roe and others")) for i, (_, text) in enumerate(texts)]
    headers = [(f"/h{i}/x.c", "/* " + text + " */\nint main;") for i, (name, text) in enumerate(texts) if name in ("MIT", "BSD-2-Clause", "BSD-3-Clause")]
    found = scan(spark, named + headers)
    assert [found[i][0] for i in range(len(texts))] == [name for name, _ in texts]
    assert [found[len(texts) + i][0] for i in range(len(headers))] == ["BSD-2-Clause", "BSD-3-Clause", "MIT"]


def test_equals_brute_force(spark):
    import math
    import re
    from collections import Counter

    templates = licenses.TEMPLATES + licenses.license_texts()
    files = [(f"/{i}/x.py", text) for i, (text, _) in enumerate(PREFIXED)] + [(f"/m/LICENSE.{i}", templates[-1][1] + " word" * i) for i in range(2)]
    parts = {i: [] for i in range(len(files))}
    corpus = [re.findall(licenses.TERM, text.lower()) for _, text in templates]
    for i, (path, text) in enumerate(files):
        lines = [line for line in text.split("\n") if re.search(licenses.HEADER, line)]
        counted = [re.findall(licenses.TERM, part.lower()) for part in lines + ([text] if "LICENSE" in path else [])]
        corpus += counted
        terms = re.findall(licenses.TERM, text.lower())
        word = [j for j, t in enumerate(terms) if re.search(licenses.HEADER, t) or terms[j : j + 3] == ["all", "rights", "reserved"]]
        parts[i] = counted + [terms[max(0, j - a) : j - a + n] for j in word for a, n in licenses.window_shapes([t for _, t in templates])]
    df = Counter(term for terms in corpus for term in set(terms))

    def vector(terms):
        weights = {t: n * (math.log((len(corpus) + 1) / (df[t] + 1)) + 1) for t, n in Counter(terms).items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / norm for t, w in weights.items()}

    known = [(name, i >= len(licenses.TEMPLATES), re.findall(licenses.TERM, text.lower())) for i, (name, text) in enumerate(templates)]
    known = [(name, full, len(terms), vector(terms)) for name, full, terms in known]
    wanted = {}
    for i, units in parts.items():
        best = []
        for unit in units:
            own = vector(unit)
            for name, full, size, weights in known:
                cosine = round(sum(w * weights.get(t, 0.0) for t, w in own.items()), 9)
                if cosine >= (0.8 if full else 0.6) and (not full or 2 * len(unit) >= size):
                    best.append((-full, -cosine, name))
        if best:
            wanted[i] = (min(best)[2], -min(best)[1])
    table = spark.createDataFrame([(i, p, t, "clash", 1) for i, (p, t) in enumerate(files)], SCHEMA)
    found = {r.doc_id: (r.license, r.similarity) for r in licenses.header_licenses(table, "doc_id").collect()}
    assert {i: name for i, (name, _) in found.items()} == {i: name for i, (name, _) in wanted.items()}
    assert all(abs(found[i][1] - wanted[i][1]) < 1e-6 for i in wanted)
