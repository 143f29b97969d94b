"""License scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance.

Lines that hold a word of licensing are the headers of a file. Compared with the templates are these
lines, the whole text of a licence file (by its name), and windows of terms: for each word of licensing
in a text and each template of at most ``WINDOW_TERMS`` terms, the terms that stand where the template's
would if its own first word of licensing stood there. So a notice is found behind a copyright line, inside
a long line or over several lines. Templates are one-line notices and the full texts in ``license_texts``.

Document frequencies are counted over all header lines and licence files and the templates. Equal lines,
windows and files are scored once, whatever their number; the sparse products are one join on terms with
the table of template weights. A full text that reaches ``LEAST_TEXT`` outranks notices, since licence texts quote
other licenses and reserve rights; else the best notice that reaches ``LEAST_COSINE`` gives the license.
A licence file also gives its license to its directory; files without a header of their own inherit
from the nearest directory above that has one, found by joining the prefixes of their directories.

Only units of texts with a licensing word and of licence files leave the scan; directories are resolved
once each, and files are joined to them by ``sized_join``, so a directory with a third of the files is no
hot group.

Defined results: a file with a null or empty text has no header; among equal cosines the first
license by name wins, among licence files of one directory the best cosine, then the first license,
then the first path; a null path inherits nothing; repeated rows are scanned each; further columns
are kept unless a result column has their name; a license without a template gets the nearest one
that reaches the least cosine; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import sized_join, text_slices
from knotwork.session import cut

LEAST_COSINE = 0.6
# Full texts: the least cosine, and the least share of their terms that a unit must have.
LEAST_TEXT = 0.8
LEAST_SHARE = 0.5
# Templates of more terms are compared with licence files only.
WINDOW_TERMS = 400
# Windows that a task remembers as already told of a text, and units of a batch.
TOLD = 100_000
BATCH_UNITS = 2_000
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
# Words that mark a line as a header, names of licence files, and template notices.
HEADER = r"(?i)\b(licen[cs]e[ds]?|licensing|copyright|copyleft|spdx-license-identifier|all rights reserved)\b"
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Licensed under the MIT License; permission is hereby granted, free of charge, to any person obtaining a copy."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying is prohibited."),
]


def template_weights(templates: list[tuple[str, str]]) -> tuple[dict[str, float], float, list[tuple[int, str, str, float]]]:
    """IDF of each term, IDF of a term in no template, and rows template, license, term, weight of unit vectors."""
    counts = [Counter(re.findall(TERM, text.lower())) for _, text in templates]
    seen = Counter(term for c in counts for term in c)
    idf = {term: math.log((1 + len(counts)) / (1 + n)) + 1 for term, n in seen.items()}
    rows = []
    for number, ((license_, _), c) in enumerate(zip(templates, counts)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(number, license_, t, n * idf[t] / norm) for t, n in c.items()]
    return idf, math.log(1 + len(counts)) + 1, rows


_TERM = re.compile(TERM)
_HEADER = re.compile(HEADER, re.ASCII)


def license_texts() -> list[tuple[str, str]]:
    """License and full text of each file in ``license_texts``."""
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return [(f.stem, f.read_text(encoding="utf-8")) for f in files]


def _anchors(terms: list[str]) -> list[int]:
    """Places of words of licensing; "all rights reserved" stands at its first word."""
    return [i for i, t in enumerate(terms) if _HEADER.search(t) or (t == "all" and terms[i + 1 : i + 3] == ["rights", "reserved"])]


def window_shapes(texts: list[str]) -> list[tuple[int, int]]:
    """Terms before the first word of licensing, and all terms, of each template that is short enough."""
    shapes = set()
    for text in texts:
        terms = _TERM.findall(text.lower())
        places = _anchors(terms)
        if places and len(terms) <= WINDOW_TERMS:
            shapes.add((places[0], len(terms)))
    return sorted(shapes)


def units(text: str, whole: bool, shapes: list[tuple[int, int]]) -> Iterator[tuple[bool, str]]:
    """Whether it counts for document frequencies, and the terms, of each part of a text that is compared."""
    stated = _HEADER.search(text) is not None
    if not stated and not whole:
        return
    terms = _TERM.findall(text.lower())
    if whole and terms:
        yield True, " ".join(terms)
    if not stated:
        return
    for line in text.split("\n"):
        if _HEADER.search(line):
            yield True, " ".join(_TERM.findall(line.lower()))
    told: set[tuple] = set()
    for place in _anchors(terms):
        for before, length in shapes:
            window = tuple(terms[max(0, place - before) : place - before + length])
            if window not in told:
                if len(told) >= TOLD:
                    told.clear()
                told.add(window)
                yield False, " ".join(window)


def header_units(files: DataFrame, key: str, shapes: list[tuple[int, int]]) -> DataFrame:
    """``key``, unit (a digest), counts, terms for each unit of the files (``key``, whole, text)."""
    kind = files.schema[key].dataType
    names = [key, "unit", "counts", "terms"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def told() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            types = (key_type, pa.string(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in text_slices(batches, "text"):
            key_type = batch.schema.field(0).type
            for name, whole, text in zip(*(c.to_pylist() for c in batch.columns)):
                for counts, terms in units(text, whole, shapes):
                    rows.append((name, hashlib.md5(terms.encode()).hexdigest(), counts, terms))
                    if len(rows) >= BATCH_UNITS:
                        yield told()
        if rows:
            yield told()

    return files.select(key, "whole", "text").mapInArrow(work, f"`{key}` {kind.simpleString()}, unit string, counts boolean, terms string")


def header_licenses(
    files: DataFrame,
    key: str,
    templates: list[tuple[str, str]] = TEMPLATES,
    least: float = LEAST_COSINE,
    texts: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """``key``, license, similarity of the best unit of each file (``key``, text, path if known) that has one."""
    spark = files.sparkSession
    texts = license_texts() if texts is None else texts
    known = [(number, license_, int(number >= len(templates)), text) for number, (license_, text) in enumerate(templates + texts)]
    counts = [(*row[:3], Counter(_TERM.findall(row[3].lower()))) for row in known]
    rows = [(number, license_, full, sum(c.values()), term, n) for number, license_, full, c in counts for term, n in c.items()]
    # As large as the templates, whatever the files are.
    table = spark.createDataFrame(rows, "template int, license string, full int, size long, term string, n long")

    whole = F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False)) if "path" in files.columns else F.lit(False)
    told = files.withColumn("whole", whole).filter(F.col("text").isNotNull() & (F.col("whole") | F.col("text").rlike(HEADER)))
    found = cut(header_units(told, key, window_shapes([text for *_, text in known])))
    single = found.groupBy("unit").agg(F.first("terms").alias("terms"), F.count_if("counts").alias("copies"))
    split = single.select("unit", "copies", F.explode(F.split("terms", " ")).alias("term")).filter(F.col("term") != "")
    counted = cut(split.groupBy("unit", "term").agg(F.count(F.lit(1)).alias("n"), F.first("copies").alias("copies")))

    total = F.lit(len(known) + found.filter("counts").count())
    seen = counted.filter(F.col("copies") > 0).select("term", "copies").unionByName(table.select("term", F.lit(1).cast("long").alias("copies")))
    idf = cut(seen.groupBy("term").agg((F.log((total + 1) / (F.sum("copies") + 1)) + 1).alias("idf")))
    other = F.log(total + 1) + 1

    raw = table.join(idf, "term").withColumn("weight", F.col("n") * F.col("idf"))
    norms = raw.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    weights = raw.join(norms, "template").select("template", "license", "full", F.col("size").alias("_size"), "term", (F.col("weight") / F.col("_norm")).alias("weight"))
    weighed = sized_join(counted, idf, ["term"]).select("unit", "term", "n", (F.col("n") * F.coalesce("idf", other)).alias("w"))
    by_unit = weighed.groupBy("unit").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("n").alias("size"), F.collect_list(F.struct("term", "w")).alias("terms")
    )
    spread = by_unit.select("unit", "norm", "size", F.inline("terms"))
    products = spread.join(F.broadcast(cut(weights)), "term").groupBy("unit", "template", "license", "full", "norm", "size", "_size")
    scored = products.agg(F.sum(F.col("w") * F.col("weight")).alias("dot")).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 9))
    enough = (F.col("full") == 1) & (F.col("similarity") >= max(least, LEAST_TEXT)) & (F.col("size") >= F.col("_size") * LEAST_SHARE)
    reached = scored.filter(enough | ((F.col("full") == 0) & (F.col("similarity") >= least)))
    order = F.min(F.struct((-F.col("full")).alias("f"), (-F.col("similarity")).alias("s"), F.col("license").alias("l")))
    by_terms = cut(reached.groupBy("unit").agg(order.alias("match")))
    matched = sized_join(found.select(key, "unit"), by_terms, ["unit"], "inner")
    best = matched.groupBy(key).agg(F.min("match").alias("best"))
    return best.select(key, F.col("best.l").alias("license"), (-F.col("best.s")).alias("similarity"))


def parent_directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, key: str, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """``files`` (``key``, path, text) with license, origin (header, inherited, none), similarity, license_path."""
    own = files.drop("license", "origin", "similarity", "license_path", "_own", "_dir", "_row")
    own = own.withColumn("_row", F.xxhash64(F.col(key), F.col("path"), F.col("text")))
    headers = cut(header_licenses(own.select("_row", "path", "text"), "_row", templates, least))
    slim = cut(own.select(key, "path", "_row").join(headers, "_row", "left").withColumn("_dir", parent_directory(F.col("path"))))
    givers = slim.filter(F.col("license").isNotNull() & F.col("path").rlike(LICENSE_FILE))
    given = givers.groupBy(F.col("_dir").alias("_above")).agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), F.col("license").alias("l"), F.col("path").alias("p"))).alias("giver")
    )
    needy = slim.filter(F.col("license").isNull() & F.col("path").isNotNull()).select("_dir").distinct()
    depth = F.posexplode(F.expr("transform(sequence(size(split(_dir, '/')), 1, -1), n -> array_join(slice(split(_dir, '/'), 1, n), '/'))"))
    above = needy.select("_dir", depth.alias("_up", "_above")).join(given, "_above")
    nearest = above.groupBy("_dir").agg(F.min_by("giver", "_up").alias("_giver"))
    resolved = sized_join(slim, nearest, ["_dir"])
    inherits = F.col("license").isNull() & F.col("_giver").isNotNull()
    return resolved.select(
        key,
        "path",
        F.when(inherits, F.col("_giver.l")).otherwise(F.col("license")).alias("license"),
        F.when(inherits, "inherited").when(F.col("license").isNotNull(), "header").otherwise("none").alias("origin"),
        F.when(inherits, -F.col("_giver.s")).otherwise(F.col("similarity")).alias("similarity"),
        F.when(inherits, F.col("_giver.p")).when(F.col("license").isNotNull(), F.col("path")).alias("license_path"),
    )
