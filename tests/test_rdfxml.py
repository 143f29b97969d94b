"""RDF/XML read by splits: every form of the grammar, and many splits against one."""

import random

import pytest

from knotwork import session
from knotwork.sources import elements, rdfxml

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
HEAD = f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:ex="http://x#">'
FORMS = f'''<?xml version="1.0"?>
<!DOCTYPE rdf:RDF [
  <!-- it's > "half -->
  <!ENTITY xsd "http://www.w3.org/2001/XMLSchema#">
  <!ENTITY gt2 "a > b">
]>
<!-- <rdf:RDF> -->
<rdf:RDF xmlns:rdf="{RDF}" xmlns:ex="http://x#" xml:base="http://b/doc" xml:lang="en">
  <ex:Person rdf:ID="p1" ex:name="Ann > Bo" ex:note='say "hi"'>
    <ex:age rdf:datatype="&xsd;int">5</ex:age>
    <ex:says xml:lang="fr">l&#39;été &gt2;</ex:says>
    <ex:none xml:lang=""/>
    <ex:knows><ex:Person rdf:about="#p2"><ex:likes rdf:resource="other"/></ex:Person></ex:knows>
    <ex:home ex:city="Ulm"/>
    <ex:at rdf:parseType="Resource"><ex:x>1</ex:x><ex:y>2</ex:y></ex:at>
  </ex:Person>
  <?skip <this> ?><!-- <ex:Person rdf:ID="no"/> -->
  <rdf:Seq rdf:nodeID="s"><rdf:li>a</rdf:li><rdf:li rdf:resource="http://x#b"/></rdf:Seq>
  <rdf:Description rdf:about="urn:c" rdf:type="http://x#Listed">
    <ex:all rdf:parseType="Collection"><rdf:Description rdf:about="http://x#m"/><ex:K rdf:about="http://x#n"/></ex:all>
    <ex:raw rdf:parseType="Literal">a <ex:b c="1">x &lt; y</ex:b><i/></ex:raw>
    <ex:cd><![CDATA[1 > 0 </ex:cd> & <x>]]></ex:cd>
    <ex:said rdf:ID="r1">yes</ex:said>
  </rdf:Description>
  <ex:Alone rdf:about="http://x#z"/>
</rdf:RDF>
<!-- end -->
'''


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture(autouse=True)
def usual_splits(spark, monkeypatch):
    # Written tables in one file: only the splits of the XML files shall be tiny.
    monkeypatch.setattr(elements, "cut", lambda rows: session.cut(rows.coalesce(1)).coalesce(2))
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def triples(spark, path, **options):
    return [tuple(r) for r in rdfxml.read_rdfxml(spark, str(path), **options).collect()]


WANTED_FORMS = {
    ("http://b/doc#p1", RDF + "type", "http://x#Person", "iri", None, None),
    ("http://b/doc#p1", "http://x#name", "Ann > Bo", "literal", None, "en"),
    ("http://b/doc#p1", "http://x#note", 'say "hi"', "literal", None, "en"),
    ("http://b/doc#p1", "http://x#age", "5", "literal", "http://www.w3.org/2001/XMLSchema#int", None),
    ("http://b/doc#p1", "http://x#says", "l'été a > b", "literal", None, "fr"),
    ("http://b/doc#p1", "http://x#none", "", "literal", None, None),
    ("http://b/doc#p1", "http://x#knows", "http://b/doc#p2", "iri", None, None),
    ("http://b/doc#p2", RDF + "type", "http://x#Person", "iri", None, None),
    ("http://b/doc#p2", "http://x#likes", "http://b/other", "iri", None, None),
    ("s", RDF + "type", RDF + "Seq", "iri", None, None),
    ("s", RDF + "_1", "a", "literal", None, "en"),
    ("s", RDF + "_2", "http://x#b", "iri", None, None),
    ("urn:c", RDF + "type", "http://x#Listed", "iri", None, None),
    ("http://x#n", RDF + "type", "http://x#K", "iri", None, None),
    ("urn:c", "http://x#raw", 'a <ex:b xmlns:ex="http://x#" c="1">x &lt; y</ex:b><i></i>', "literal", RDF + "XMLLiteral", None),
    ("urn:c", "http://x#cd", "1 > 0 </ex:cd> & <x>", "literal", None, "en"),
    ("urn:c", "http://x#said", "yes", "literal", None, "en"),
    ("http://b/doc#r1", RDF + "type", RDF + "Statement", "iri", None, None),
    ("http://b/doc#r1", RDF + "subject", "urn:c", "iri", None, None),
    ("http://b/doc#r1", RDF + "predicate", "http://x#said", "iri", None, None),
    ("http://b/doc#r1", RDF + "object", "yes", "literal", None, "en"),
    ("http://x#z", RDF + "type", "http://x#Alone", "iri", None, None),
}


@pytest.mark.parametrize("size", [60, 10_000_000])
def test_every_form_in_splits_of_any_size(spark, tmp_path, size):
    (tmp_path / "forms.rdf").write_text(FORMS, encoding="utf-8")
    small_splits(spark, size)
    rows = triples(spark, tmp_path)
    made = [r for r in rows if r[0].startswith("g") or r[3].startswith("g") and r[4] == "bnode"]
    assert {(r[0], *r[2:]) for r in rows if r not in made} == WANTED_FORMS
    assert len(rows) == len(WANTED_FORMS) + len(made) and len(made) == 10
    about = {r[0]: {} for r in made if r[1] == "bnode"}
    for r in made:
        about.setdefault(r[0], {})[r[2]] = r[3]
    home, place, cell = (about["http://b/doc#p1" if n != "all" else "urn:c"]["http://x#" + n] for n in ("home", "at", "all"))
    assert about[home] == {"http://x#city": "Ulm"} and about[place] == {"http://x#x": "1", "http://x#y": "2"}
    rest = about[cell][RDF + "rest"]
    assert about[cell][RDF + "first"] == "http://x#m" and about[rest] == {RDF + "first": "http://x#n", RDF + "rest": RDF + "nil"}


def test_files_keep_their_own_prefixes(spark, tmp_path):
    for name, space in (("a", "http://a#"), ("b", "http://b#")):
        (tmp_path / f"{name}.rdf").write_text(
            f'<r:RDF xmlns:r="{RDF}" xmlns:p="{space}"><p:C r:about="http://x#{name}"><p:v>1</p:v></p:C></r:RDF>'
        )
    assert {(r[0], r[2]) for r in triples(spark, tmp_path)} == {
        ("http://x#a", RDF + "type"), ("http://x#a", "http://a#v"), ("http://x#b", RDF + "type"), ("http://x#b", "http://b#v"),
    }


def test_a_root_that_is_a_node(spark, tmp_path):
    (tmp_path / "n.rdf").write_text(f'<e:C xmlns:e="http://x#" xmlns:rdf="{RDF}" e:a="1"><e:b>2</e:b><e:c rdf:resource="http://x#d"/></e:C>')
    small_splits(spark, 30)
    rows = triples(spark, tmp_path, distinct=False)
    assert len({r[0] for r in rows}) == 1 and sorted((r[2][-4:], r[3]) for r in rows) == sorted(
        [("type", "http://x#C"), ("tp://x#a"[-4:], "1"), ("tp://x#b"[-4:], "2"), ("tp://x#c"[-4:], "http://x#d")]
    )


def test_empty_roots_and_broken_files(spark, tmp_path):
    (tmp_path / "empty.rdf").write_text("")
    (tmp_path / "closed.rdf").write_text(HEAD[:-1] + "/>")
    (tmp_path / "none.rdf").write_text(f"﻿{HEAD}\n</rdf:RDF>", encoding="utf-8")
    assert triples(spark, tmp_path) == []
    for i, text in enumerate([f'{HEAD}<rdf:Description rdf:about="http://x#a"><ex:p>1</rdf:Description></rdf:RDF>', f"{HEAD}<ex:C><ex:p>cut", "no markup"]):
        (tmp_path / f"bad{i}").mkdir()
        (tmp_path / f"bad{i}" / "x.rdf").write_text(text)
        with pytest.raises(Exception, match="x.rdf"):
            triples(spark, tmp_path / f"bad{i}")


def drawn(seed, n):
    draw = random.Random(seed)
    texts = ["a", "1 &gt; 0", "x > y", "'", '"', "<!-- > ' -->", "<![CDATA[<q> ]] > ']]>", "<?i > ?>", "\n", "é"]
    out = []
    for i in range(n):
        name = f"http://x#n{seed}_{i}"
        value = "".join(draw.choices(texts, k=draw.randint(0, 5)))
        out.append(draw.choice([
            f'<rdf:Description rdf:about="{name}"><ex:p>{value}</ex:p></rdf:Description>',
            f"<ex:C rdf:about='{name}' ex:q='a > \"b'/>",
            f'<ex:C rdf:about="{name}"><ex:in><ex:D rdf:about="{name}d"><ex:p>{value}</ex:p></ex:D></ex:in></ex:C>',
            f'<ex:C\n rdf:about="{name}"\n><ex:p>{value * 30}</ex:p><ex:q rdf:resource="{name}>"/></ex:C  >',
        ]) + draw.choice(["", "\n  ", "<!-- <ex:C> ' -->", "<?a <b> ?>"]))
    return "".join(out)


@pytest.mark.parametrize("size, bounded", [(1_500, True), (1_500, False), (20_000, True)])
def test_many_splits_give_the_one_split_result(spark, tmp_path, monkeypatch, size, bounded):
    for seed in range(2):
        (tmp_path / f"{seed}.rdf").write_text(f"{HEAD}{drawn(seed, 90)}</rdf:RDF>", encoding="utf-8")
    wanted = sorted(triples(spark, tmp_path, distinct=False), key=str)
    if not bounded:
        monkeypatch.setattr(elements, "BESIDE_BYTES", -1)
    small_splits(spark, size)
    assert sorted(triples(spark, tmp_path, distinct=False), key=str) == wanted and len(wanted) > 150
