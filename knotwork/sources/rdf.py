"""N-Triples and tab-separated triples.

A triples table has ``subj, subj_kind, pred, obj, obj_kind, obj_datatype, obj_lang``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.session import scratch

TRIPLES = "subj string, subj_kind string, pred string, obj string, obj_kind string, obj_datatype string, obj_lang string"
# The form of an N-Triples line whose escaped backslashes and quotes are behind marks,
# so that a literal is a plain run without quotes however long it is. The fourth group tells the kind of the object.
NT_LINE = (
    r'^\s*(?:<([^>]*)>|_:(\S+))\s*<([^>]*)>\s*(?=(.))'
    r'(?:<([^>]*)>|_:([^\s.]+(?:\.+[^\s.]+)*)|"([^"]*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$'
)
NT_SKIPPED = r"^\s*(#.*)?$"
RDF_NAMESPACE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
# Escapes of N-Triples strings.
ESCAPES = [("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\'", "'"), ("\\b", "\b"), ("\\f", "\f")]
# A mark in the data itself is written as MARK and "m", so it is never taken for an escape.
MARK = "\u0001"
MARKED = [(MARK, f"{MARK}m"), ("\\\\", f"{MARK}b"), ('\\"', f"{MARK}q")]


# Ends a part of a line; protected text has no such mark.
PART_END = f"{MARK}s"
PARTS = 9


def _marked(text: Column) -> Column:
    return F.contains(text, F.lit("\\")) | F.contains(text, F.lit(MARK))


def _protect(line: Column) -> Column:
    """Escaped backslashes and quotes behind marks, so that only real quotes and escapes are left."""
    out = line
    for found, meant in MARKED:
        out = F.replace(out, F.lit(found), F.lit(meant))
    return F.when(_marked(line), out).otherwise(line)


def _parts(line: Column) -> Column:
    """The groups of ``NT_LINE`` from one match, and what follows the last; a line that is no triple is one part."""
    ends = "".join(f"${i}{PART_END}" for i in range(1, PARTS + 1))
    return F.split(F.regexp_replace(_protect(line), NT_LINE, ends), PART_END)


def _decode(text: Column) -> Column:
    """Meaning of a protected string, \\uXXXX and \\UXXXXXXXX included."""
    plain = text
    for escaped, meant in ESCAPES:
        plain = F.replace(plain, F.lit(escaped), F.lit(meant))
    # Split at code escapes; each piece after the first starts with its hex digits.
    pieces = F.split(F.regexp_replace(plain, r"\\u([0-9A-Fa-f]{4})", r"\\U0000$1"), r"\\U(?=[0-9A-Fa-f]{8})")
    codes = F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.concat(F.decode(F.unhex(F.substring(p, 1, 8)), "UTF-32"), F.substring(p, 9, 2_000_000_000)),
    )
    joined = F.concat(F.element_at(pieces, 1), F.array_join(codes, ""))
    out = F.when(F.contains(plain, F.lit("\\")), joined).otherwise(plain)
    for meant, mark in (('"', "q"), ("\\", "b"), (MARK, "m")):
        out = F.replace(out, F.lit(MARK + mark), F.lit(meant))
    return F.when(_marked(text), out).otherwise(text)


def parse_ntriples(lines: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Triples and the lines (value) that are none; empty lines and comments are skipped. With ``strict``
    reading the triples ends in an error at a line that is none."""
    value = F.col("value")
    bad = lines.filter(~value.rlike(NT_SKIPPED) & (F.size(_parts(value)) != PARTS + 1))

    def whole(parts: Column) -> Column:
        found = F.size(parts) == PARTS + 1
        if not strict:
            return found
        broken = F.raise_error(F.concat(F.lit("no triple: "), F.substring("value", 1, 200))).cast("boolean")
        return F.when(found, True).when(value.rlike(NT_SKIPPED), False).otherwise(broken)

    # A generator, so that no filter repeats the match.
    good = lines.select(F.explode(F.filter(F.array(_parts(value)), whole)).alias("_parts"))
    part = [F.element_at("_parts", i) for i in range(1, PARTS + 1)]
    literal, bnode = part[3] == '"', part[3] == "_"
    triples = good.select(
        F.when(part[1] != "", part[1]).otherwise(_decode(part[0])).alias("subj"),
        F.when(part[1] != "", "bnode").otherwise("iri").alias("subj_kind"),
        _decode(part[2]).alias("pred"),
        F.when(literal, _decode(part[6])).when(bnode, part[5]).otherwise(_decode(part[4])).alias("obj"),
        F.when(literal, "literal").when(bnode, "bnode").otherwise("iri").alias("obj_kind"),
        F.nullif(part[7], F.lit("")).alias("obj_datatype"),
        F.nullif(part[8], F.lit("")).alias("obj_lang"),
    )
    return triples, bad


def read_ntriples(spark: SparkSession, path: str, distinct: bool = True, strict: bool = False) -> DataFrame:
    """Line-oriented RDF; the files are split like any text. A graph is a set, so repeats go.

    With ``strict`` a line that is no triple ends the job with an error; without it such lines are
    left out and ``bad_ntriples`` lists them.
    """
    triples, _ = parse_ntriples(spark.read.text(path), strict)
    return triples.dropDuplicates() if distinct else triples


def bad_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the file that are not triples."""
    return parse_ntriples(spark.read.text(path))[1]


def _encode(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for escaped, meant in [('\\"', '"'), *ESCAPES[:3]]:
        out = F.replace(out, F.lit(meant), F.lit(escaped))
    return out


def write_ntriples(triples: DataFrame, path: str | None = None) -> str:
    """Write triples as N-Triples lines and return where they are."""
    target = path or scratch(triples.sparkSession, "ntriples")

    def term(side: str) -> Column:
        text = F.col(side)
        iri = F.concat(F.lit("<"), text, F.lit(">"))
        return F.when(F.col(f"{side}_kind") == "bnode", F.concat(F.lit("_:"), text)).otherwise(iri)

    suffix = F.lit("")
    if "obj_datatype" in triples.columns:
        suffix = F.when(F.col("obj_datatype").isNotNull(), F.concat(F.lit("^^<"), "obj_datatype", F.lit(">"))).when(
            F.col("obj_lang").isNotNull(), F.concat(F.lit("@"), "obj_lang")
        ).otherwise("")
    literal = F.concat(F.lit('"'), _encode(F.col("obj")), F.lit('"'), suffix)
    obj = F.when(F.col("obj_kind") == "literal", literal).otherwise(term("obj"))
    line = F.concat_ws(" ", term("subj"), F.concat(F.lit("<"), "pred", F.lit(">")), obj, F.lit("."))
    triples.select(line.alias("value")).write.text(target)
    return target


# Escapes that keep a text on one line of a separated file, and the sign for null.
LINE_ESCAPES = [("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")]
NULL_SIGN = "\\N"


def escape_field(text: Column) -> Column:
    """A text without tabs and line breaks; null is told apart from an empty text."""
    out = text
    for meant, escaped in LINE_ESCAPES:
        out = F.replace(out, F.lit(meant), F.lit(escaped))
    return F.coalesce(out, F.lit(NULL_SIGN))


def unescape_field(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit(MARK), F.lit(f"{MARK}m")), F.lit("\\\\"), F.lit(f"{MARK}b"))
    for meant, escaped in LINE_ESCAPES[1:]:
        out = F.replace(out, F.lit(escaped), F.lit(meant))
    out = F.replace(F.replace(out, F.lit(f"{MARK}b"), F.lit("\\")), F.lit(f"{MARK}m"), F.lit(MARK))
    return F.when(text != NULL_SIGN, out)


def read_triples_tsv(spark: SparkSession, path: str, header: bool = False, escaped: bool = True) -> DataFrame:
    """head, relation, tail; ``escaped`` undoes what ``write_triples_tsv`` did to tabs and line breaks.

    Each line is split at its tabs as it stands: blanks, quotes and empty texts are kept. With a header
    the first line of each file is left out, whatever it says; no other line is.
    """
    names = ["head", "relation", "tail"]
    fields = F.split("value", "\t", 3)
    lines = spark.read.text(path, lineSep="\n")
    if header:
        placed = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

        def untitled(batches):
            last = None
            for batch in batches:
                files, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                keep = []
                for block in zip(files, starts):
                    # The lines of a block come in order; the first of the block at 0 is the file's first.
                    keep.append(block == last or block[1] != 0)
                    last = block
                yield batch.select([0]).filter(pa.array(keep, pa.bool_()))

        lines = placed.mapInArrow(untitled, "value string")
    read = unescape_field if escaped else (lambda text: text)
    return lines.select(*[read(F.get(fields, F.lit(i))).alias(n) for i, n in enumerate(names)])


def write_triples_tsv(triples: DataFrame, header: bool = False, path: str | None = None) -> str:
    """One line for each triple, tabs and line breaks in texts escaped; a header names the columns in each file."""
    target = path or scratch(triples.sparkSession, "triples")
    names = ["head", "relation", "tail"]
    lines = triples.select(F.concat_ws("\t", *[escape_field(F.col(n)) for n in names]).alias("value"))

    def titled(batches):
        yield pa.RecordBatch.from_pydict({"value": ["\t".join(names)]})
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    if header:
        lines = lines.mapInArrow(titled, "value string")
    lines.write.text(target, lineSep="\n")
    return target
