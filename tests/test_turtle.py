from __future__ import annotations

import pytest

from attestry.sources import graphs, turtle

X, RDF = "http://www.w3.org/2001/XMLSchema#", turtle.RDF
HEAD = "@prefix : <urn:e:> .\nPREFIX x: <http://www.w3.org/2001/XMLSchema#>\n"


@pytest.mark.parametrize(
    "told, wanted",
    [
        ("<urn:s> a :T .", [f"<urn:s> <{RDF}type> <urn:e:T> ."]),
        (":s :p 1, -2.5, 1e3, true ; :q 'x'@EN-gb .", [f'<urn:e:s> <urn:e:p> "{v}"^^<{X}{t}> .' for v, t in (("1", "integer"), ("-2.5", "decimal"), ("1e3", "double"), ("true", "boolean"))] + ['<urn:e:s> <urn:e:q> "x"@en-gb .']),
        (":s :p 5.", [f'<urn:e:s> <urn:e:p> "5"^^<{X}integer> .']),
        (':s :p "2020-01-01"^^x:date ; .', [f'<urn:e:s> <urn:e:p> "2020-01-01"^^<{X}date> .']),
        (':s :p "a"^^x:string .', ['<urn:e:s> <urn:e:p> "a" .']),
        (':s :p """a "q" \\u00e9\nb""" . # end', ['<urn:e:s> <urn:e:p> "a \\"q\\" é\\nb" .']),
        ("[ :p :o ] .", ["_:g0 <urn:e:p> <urn:e:o> ."]),
        ("[] :p _:b.c .", ["_:g0 <urn:e:p> _:ub.c ."]),
        (":s :p [ :q [ :r :o ] ] .", ["_:g1 <urn:e:r> <urn:e:o> .", "_:g0 <urn:e:q> _:g1 .", "<urn:e:s> <urn:e:p> _:g0 ."]),
        (":s :p () .", [f"<urn:e:s> <urn:e:p> <{RDF}nil> ."]),
        (":s :p (:a) .", [f"_:g0 <{RDF}first> <urn:e:a> .", f"_:g0 <{RDF}rest> <{RDF}nil> .", "<urn:e:s> <urn:e:p> _:g0 ."]),
        ("@base <http://b.example/d/> . <e> :p <../f> .", ["<http://b.example/d/e> <urn:e:p> <http://b.example/f> ."]),
        (":a.b :p\\-q :c%20d .", ["<urn:e:a.b> <urn:e:p-q> <urn:e:c%20d> ."]),
        (":s :p :o . :s :p :o .", ["<urn:e:s> <urn:e:p> <urn:e:o> ."]),
        ("", []),
    ],
)
def test_turtle_lines(told, wanted):
    assert turtle.lines_of(HEAD + told) == wanted


@pytest.mark.parametrize("told", [":s :p .", ":s :p :o", "y:s :p :o .", ":s 'p' :o .", ":s :p 'open .", "{ :s :p :o }", ":s _:p :o .", ":s :p (:a ."])
def test_turtle_that_is_not_well_formed(told):
    with pytest.raises(ValueError):
        turtle.lines_of(HEAD + told)


def test_trig_blocks():
    told = HEAD + ":a :p :o . { :b :p :o . :c :p :o } GRAPH :g { :d :p :o } :h { :e :p 1 . }"
    assert turtle.lines_of(told, graphs=True) == [f"<urn:e:{s}> <urn:e:p> <urn:e:o> ." for s in "abc"] + ["<urn:e:d> <urn:e:p> <urn:e:o> <urn:e:g> .", f'<urn:e:e> <urn:e:p> "1"^^<{X}integer> <urn:e:h> .']


def test_turtle_table(spark):
    """Blank nodes stay apart by document; a bad document gives an error row, a null one nothing."""
    docs = spark.createDataFrame([(1, "[] <urn:p> 'x' ."), (2, "[] <urn:p> 'y' ."), (3, "oops"), (4, None), (5, "")], "doc_id int, text string")
    lines = graphs.turtle_lines(docs, "doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in lines if r["error"] is None) == [1, 2]
    assert [r["doc_id"] for r in lines if r["error"]] == [3]
    table = graphs.build_graph(docs, "doc_id", "text", "text/turtle").collect()
    assert {(r["s"], r["o"]) for r in table} == {("1/g0", "x"), ("2/g0", "y")}
    assert graphs.build_graph(docs.where("false"), "doc_id", "text", "application/trig").count() == 0


# --- RDF/XML and further forms of JSON-LD --------------------------------------------------------

XML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="urn:e:" xml:base="http://x.org/d/">
  <e:Person rdf:about="a" e:nick="A &quot;q&quot;" xml:lang="EN">
    <e:name>Ada</e:name>
    <e:plain xml:lang="">x</e:plain>
    <e:age rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">36</e:age>
    <e:knows rdf:resource="#b"/>
    <e:home rdf:parseType="Resource"><e:city>Linz</e:city></e:home>
    <e:list rdf:parseType="Collection"><rdf:Description rdf:about="c"/><rdf:Description rdf:nodeID="n"/></e:list>
    <e:near><e:Place rdf:ID="p"/></e:near>
    <e:made e:by="me"/>
  </e:Person>
  <rdf:Bag rdf:about="bag"><rdf:li>1</rdf:li><rdf:li rdf:ID="s">2</rdf:li></rdf:Bag>
</rdf:RDF>"""


def test_rdf_xml():
    from attestry.sources import rdfxml

    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    told = set(rdfxml.lines_of(XML))
    a = "<http://x.org/d/a>"
    want = {
        f"{a} <{rdf}type> <urn:e:Person> .", f'{a} <urn:e:nick> "A \\"q\\""@en .', f'{a} <urn:e:name> "Ada"@en .', f'{a} <urn:e:plain> "x" .', f'{a} <urn:e:age> "36"^^<http://www.w3.org/2001/XMLSchema#integer> .',
        f"{a} <urn:e:knows> <http://x.org/d/#b> .", f"{a} <urn:e:home> _:g1 .", '_:g1 <urn:e:city> "Linz"@en .', f"<http://x.org/d/#p> <{rdf}type> <urn:e:Place> .", f"{a} <urn:e:near> <http://x.org/d/#p> .",
        f'<http://x.org/d/bag> <{rdf}_1> "1" .', f'<http://x.org/d/bag> <{rdf}_2> "2" .', f"<http://x.org/d/#s> <{rdf}subject> <http://x.org/d/bag> .", f'<http://x.org/d/#s> <{rdf}object> "2" .',
    }
    assert want <= told and sum(f"<{rdf}first>" in x for x in told) == 2 and any('<urn:e:by> "me"@en' in x for x in told)


def test_rdf_xml_tables_and_errors(spark):
    docs = spark.createDataFrame([(1, XML), (2, "<rdf"), (3, None)], "doc_id long, text string")
    got = graphs.load_rdf_xml(docs, "doc_id", "text")
    assert got.where("doc_id = '1'").count() == got.count() > 20
    assert [r.doc_id for r in graphs.load_errors(docs, "doc_id", "text", "application/rdf+xml").collect()] == [2]
    with pytest.raises(Exception, match="document 2"):
        graphs.build_graph(docs, "doc_id", "text", "application/rdf+xml").collect()


def test_json_ld_reverse_included_and_containers():
    import json

    context = {
        "@vocab": "urn:v:", "childOf": {"@reverse": "parent"}, "label": {"@container": "@language"}, "post": {"@container": "@index"}, "part": {"@container": "@id"}, "kind": {"@container": "@type"},
        "claim": {"@container": "@graph"}, "tags": {"@container": "@set"}, "deep": {"@context": {"name": "urn:w:name"}},
    }
    doc = {
        "@context": context, "@id": "urn:a", "@reverse": {"knows": [{"@id": "urn:b"}, "urn:c"]}, "childOf": {"@id": "urn:d", "name": "D"}, "@included": [{"@id": "urn:e", "name": "E"}],
        "label": {"en": ["x", "y"], "@none": "z"}, "post": {"1": {"@id": "urn:p1"}, "2": ["t"]}, "part": {"urn:q": {"name": "Q"}}, "kind": {"Big": {"@id": "urn:k"}}, "claim": {"@id": "urn:s", "name": "S"}, "tags": ["u", "v"], "deep": {"@id": "urn:i", "name": "I"},
    }
    told = set(graphs.lines_of(json.dumps(doc), {}, None))
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    want = {
        "<urn:b> <urn:v:knows> <urn:a> .", "<urn:c> <urn:v:knows> <urn:a> .", "<urn:d> <urn:v:parent> <urn:a> .", '<urn:d> <urn:v:name> "D" .', '<urn:e> <urn:v:name> "E" .', '<urn:a> <urn:v:label> "x"@en .', '<urn:a> <urn:v:label> "y"@en .', '<urn:a> <urn:v:label> "z" .',
        "<urn:a> <urn:v:post> <urn:p1> .", '<urn:a> <urn:v:post> "t" .', "<urn:a> <urn:v:part> <urn:q> .", '<urn:q> <urn:v:name> "Q" .', "<urn:a> <urn:v:kind> <urn:k> .", f"<urn:k> <{rdf}type> <urn:v:Big> .", "<urn:a> <urn:v:claim> _:b0 .", '<urn:s> <urn:v:name> "S" _:b0 .',
        '<urn:a> <urn:v:tags> "u" .', '<urn:a> <urn:v:tags> "v" .', "<urn:a> <urn:v:deep> <urn:i> .", '<urn:i> <urn:w:name> "I" .',
    }
    assert told == want
