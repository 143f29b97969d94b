"""RDF/XML as triples: all forms of the grammar, each file with its own prefixes, base and entities."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from urllib.parse import urljoin
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators.triples import distinct_triples
from knotwork.sources.elements import read_elements
from knotwork.sources.rdf import RDF_NAMESPACE, TRIPLES

COLUMNS = [part.split()[0] for part in TRIPLES.split(", ")]
# Names of the grammar that are neither properties nor classes, and the XML namespace.
SYNTAX = {RDF_NAMESPACE + name for name in ("RDF", "ID", "about", "parseType", "resource", "nodeID", "datatype")}
XML_NAMESPACE = "http://www.w3.org/XML/1998/namespace"
XML_LITERAL = RDF_NAMESPACE + "XMLLiteral"
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
SPACE = "\x01"
# Triples that leave a task together; one row of elements may go beyond it.
BATCH_ROWS = 8_192
# Bytes of text that stand for a triple where the parts without repeats are counted.
TRIPLE_BYTES = 100


@dataclass
class Frame:
    """An open element: the root, a node with its subject, or a property of the node around it."""

    kind: str
    base: str
    lang: str | None
    subject: tuple[str, str] | None = None
    items: int = 0
    pred: str = ""
    mark: str | None = None
    datatype: str | None = None
    filled: bool = False
    mode: str = "plain"
    text: list[str] = field(default_factory=list)
    members: list[tuple[str, str]] = field(default_factory=list)
    spaces: dict[str, str] = field(default_factory=dict)


class Reader:
    """Triples of one document made of a head and some elements of its root.

    ``own`` asks for the triples of the root itself, for the case that it is a node.
    """

    def __init__(self, name: str, root: str, own: bool, base: str) -> None:
        self.name, self.root, self.own, self.base = name, root, own, base
        self.made, self.rows, self.stack = 0, [], []

    def read(self, head: str, text: str) -> list[tuple]:
        parser = expat.ParserCreate(namespace_separator=SPACE)
        parser.namespace_prefixes = True
        parser.buffer_text = True
        parser.StartElementHandler = self.start
        parser.EndElementHandler = self.end
        parser.CharacterDataHandler = self.chars
        tag = re.match(r"<[^\s/>]+", head[max(head.rfind("<"), 0) :])
        closing = f"</{tag.group(0)[1:]}>" if tag and not head.rstrip().endswith("/>") else ""
        parser.Parse(head.lstrip("﻿") + text + closing, True)
        return self.rows

    # Terms

    def fresh(self) -> tuple[str, str]:
        self.made += 1
        return f"g{self.name}_{self.made}", "bnode"

    def resolve(self, base: str, ref: str) -> tuple[str, str]:
        if SCHEME.match(ref):
            return ref, "iri"
        if not ref or ref.startswith("#"):
            return base.partition("#")[0] + ref, "iri"
        return urljoin(base, ref), "iri"

    def emit(self, subject, pred, obj, kind="iri", datatype=None, lang=None, mark=None) -> None:
        self.rows.append((*subject, pred, obj, kind, datatype, lang))
        if mark:
            statement = (mark, "iri")
            self.rows.append((*statement, RDF_NAMESPACE + "type", RDF_NAMESPACE + "Statement", "iri", None, None))
            self.rows.append((*statement, RDF_NAMESPACE + "subject", *subject, None, None))
            self.rows.append((*statement, RDF_NAMESPACE + "predicate", pred, "iri", None, None))
            self.rows.append((*statement, RDF_NAMESPACE + "object", obj, kind, datatype, lang))

    def attributes(self, subject, frame: Frame, attrs: dict[str, str]) -> None:
        """Property attributes of a node."""
        for name, value in attrs.items():
            if name == RDF_NAMESPACE + "type":
                self.emit(subject, name, *self.resolve(frame.base, value))
            else:
                self.emit(subject, name, value, "literal", lang=frame.lang)

    # Events

    def start(self, raw: str, found: dict[str, str]) -> None:
        above = self.stack[-1] if self.stack else None
        if above and above.mode == "xml":
            self.stack.append(self.copy(above, raw, found))
            return
        parts = raw.split(SPACE)
        name = "".join(parts[:2]) if len(parts) > 1 else raw
        attrs, base, lang = {}, above.base if above else self.base, above.lang if above else None
        for key, value in found.items():
            space = key.split(SPACE)
            if space[0] == XML_NAMESPACE:
                if space[1] == "base":
                    base = self.resolve(base, value)[0]
                elif space[1] == "lang":
                    lang = value or None
            elif len(space) > 1:
                attrs["".join(space[:2])] = value
        frame = Frame("root", base, lang)
        if not above and name == RDF_NAMESPACE + "RDF":
            pass
        elif not above or above.kind in ("root", "property"):
            if above and above.kind == "property" and (above.mode not in ("plain", "list") or (above.filled and above.mode == "plain")):
                raise ValueError(f"a second node or a wrong place: {name}")
            self.node(frame, name, attrs, above)
        else:
            self.property(frame, name, attrs, above)
        self.stack.append(frame)

    def node(self, frame: Frame, name: str, attrs: dict[str, str], above: Frame | None) -> None:
        frame.kind = "node"
        about, mark, label = (attrs.pop(RDF_NAMESPACE + n, None) for n in ("about", "ID", "nodeID"))
        if mark is not None:
            frame.subject = self.resolve(frame.base, "#" + mark)
        elif label is not None:
            frame.subject = label, "bnode"
        elif about is not None:
            frame.subject = self.resolve(frame.base, about)
        else:
            frame.subject = self.fresh() if above else (f"g{self.root}", "bnode")
        if above or self.own:
            if name != RDF_NAMESPACE + "Description":
                self.emit(frame.subject, RDF_NAMESPACE + "type", name)
            self.attributes(frame.subject, frame, {k: v for k, v in attrs.items() if k not in SYNTAX})
        if above and above.kind == "property":
            above.filled = True
            if above.mode == "list":
                above.members.append(frame.subject)
            else:
                self.emit(above.subject, above.pred, *frame.subject, mark=above.mark)

    def property(self, frame: Frame, name: str, attrs: dict[str, str], above: Frame) -> None:
        frame.kind, frame.subject = "property", above.subject
        if name == RDF_NAMESPACE + "li":
            if len(self.stack) == 1:
                raise ValueError("rdf:li right below a root that is a node")
            above.items += 1
            name = f"{RDF_NAMESPACE}_{above.items}"
        frame.pred = name
        mark, kind, resource, label, frame.datatype = (
            attrs.pop(RDF_NAMESPACE + n, None) for n in ("ID", "parseType", "resource", "nodeID", "datatype")
        )
        frame.mark = self.resolve(frame.base, "#" + mark)[0] if mark is not None else None
        if frame.datatype is not None:
            frame.datatype = self.resolve(frame.base, frame.datatype)[0]
        attrs = {k: v for k, v in attrs.items() if k not in SYNTAX}
        if kind == "Resource":
            inner = self.fresh()
            self.emit(frame.subject, name, *inner, mark=frame.mark)
            # Its children are properties of the new node.
            frame.kind, frame.subject = "node", inner
        elif kind == "Collection":
            frame.mode = "list"
        elif kind is not None:
            frame.mode = "xml"
        elif resource is not None or label is not None or attrs:
            if resource is not None:
                obj = self.resolve(frame.base, resource)
            else:
                obj = (label, "bnode") if label is not None else self.fresh()
            self.emit(frame.subject, name, *obj, mark=frame.mark)
            self.attributes(obj, frame, attrs)
            frame.mode = "done"

    def chars(self, data: str) -> None:
        frame = self.stack[-1]
        if frame.mode == "xml":
            frame.text.append(escape(data, {"\r": "&#xD;"}))
        elif frame.kind == "property" and frame.mode == "plain":
            frame.text.append(data)

    def end(self, raw: str) -> None:
        frame = self.stack.pop()
        if frame.kind == "copy":
            # Pieces of an XML literal go up to the property that holds it.
            self.stack[-1].text.extend([*frame.text, f"</{frame.pred}>"])
        elif frame.kind != "property":
            return
        elif frame.mode == "xml":
            self.emit(frame.subject, frame.pred, "".join(frame.text), "literal", XML_LITERAL, mark=frame.mark)
        elif frame.mode == "list":
            self.collection(frame)
        elif frame.mode == "plain" and not frame.filled:
            lang = None if frame.datatype else frame.lang
            self.emit(frame.subject, frame.pred, "".join(frame.text), "literal", frame.datatype, lang, frame.mark)

    def collection(self, frame: Frame) -> None:
        nil = (RDF_NAMESPACE + "nil", "iri")
        cells = [self.fresh() for _ in frame.members] + [nil]
        self.emit(frame.subject, frame.pred, *cells[0], mark=frame.mark)
        for cell, member, rest in zip(cells, frame.members, cells[1:]):
            self.emit(cell, RDF_NAMESPACE + "first", *member)
            self.emit(cell, RDF_NAMESPACE + "rest", *rest)

    def copy(self, above: Frame, raw: str, found: dict[str, str]) -> Frame:
        """An element inside an XML literal, written with the namespaces that it uses."""
        frame = Frame("copy", above.base, above.lang, mode="xml", spaces=dict(above.spaces))
        declared = {}

        def written(name: str, tag: bool) -> str:
            parts = name.split(SPACE)
            prefix = parts[2] if len(parts) > 2 else ""
            uri = parts[0] if len(parts) > 1 else ""
            if uri == XML_NAMESPACE:
                return f"xml:{parts[1]}"
            if (tag or prefix) and frame.spaces.get(prefix, "") != uri:
                declared[prefix] = frame.spaces[prefix] = uri
            return f"{prefix}:{parts[1]}" if prefix else parts[1] if len(parts) > 1 else name

        frame.pred = written(raw, True)
        # Attributes in the order of their namespaces and names.
        order = sorted(found, key=lambda key: key.split(SPACE)[:2] if SPACE in key else ["", key])
        rest = {'"': "&quot;", "\t": "&#x9;", "\n": "&#xA;", "\r": "&#xD;"}

        def quoted(value: str) -> str:
            return escape(value, rest).replace("&gt;", ">")

        own = [f' {written(key, False)}="{quoted(found[key])}"' for key in order]
        spaces = [f' xmlns{":" + p if p else ""}="{quoted(uri)}"' for p, uri in sorted(declared.items())]
        frame.text.append(f"<{frame.pred}{''.join(spaces)}{''.join(own)}>")
        return frame


def parsed(batches: Iterator[pa.RecordBatch], base: str = "") -> Iterator[pa.RecordBatch]:
    """Triples of elements (file, start, number, head, text), one row at a time: a batch of elements is up to 64 MB and
    would be ten times that as Python tuples."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * len(COLUMNS)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=COLUMNS)

    for batch in batches:
        rows = []
        for place in range(batch.num_rows):
            file, start, number, head, text = (column[place].as_py() for column in batch.columns)
            root = hashlib.sha1(file.encode()).hexdigest()[:16]
            reader = Reader(f"{root}_{start}_{number}".replace("-", "x"), root, not text, base)
            try:
                rows += reader.read(head, text)
            except (expat.ExpatError, ValueError) as fault:
                raise ValueError(f"{file}: {fault}") from fault
            if len(rows) >= BATCH_ROWS:
                yield batch_of(rows)
                rows = []
        yield batch_of(rows)


def read_rdfxml(spark: SparkSession, path: str, distinct: bool = True, base: str = "") -> DataFrame:
    """Triples of RDF/XML files: descriptions and typed nodes, ``rdf:about``, ``rdf:ID`` and ``rdf:nodeID``, nested
    nodes, property attributes, ``rdf:li``, the three kinds of ``rdf:parseType``, reified statements, ``xml:base`` and
    ``xml:lang``, entities, and a root that is a node itself.

    Files are split between the elements of the root (``elements.read_elements``), without a schema pass; one
    such element is read by one task. Relative names are resolved against ``xml:base``, or ``base`` where a file
    has none. Labels of ``rdf:nodeID`` are kept, so files that use one label speak of one node; nodes without a
    name get labels that are unique among files and the same in each run. Text keeps its white space. Files
    must be in UTF-8; one that is no XML ends the job with an error. A file without elements has no triples.
    """
    elements = read_elements(spark, path)
    triples = elements.mapInArrow(partial(parsed, base=base), TRIPLES)
    if not distinct:
        return triples
    size = elements.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return distinct_triples(triples, rows=size // TRIPLE_BYTES)
