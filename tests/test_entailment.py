"""Entailment against a plain fixed point, table functions and their errors, escapes of all kinds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from attestry.operators import entailment as e
from attestry.operators import quads
from attestry.sources import graphs, table_functions

TYPE = quads.RDF_TYPE


def fixed_point(rows, rules):
    known = set(rows)
    while True:
        new = set()
        for s, p, o, literal in known:
            for a, q, b, _ in known:
                if "subclass" in rules and q == e.SUBCLASS and o == a and not literal and p in (TYPE, e.SUBCLASS):
                    new.add((s, p, b, False))
                if "subproperty" in rules and q == e.SUBPROPERTY and p == a:
                    new.add((s, b, o, literal))
                if "subproperty" in rules and q == e.SUBPROPERTY and p == e.SUBPROPERTY and o == a:
                    new.add((s, p, b, False))
                if "domain" in rules and q == e.DOMAIN and p == a:
                    new.add((s, TYPE, b, False))
                if "range" in rules and q == e.RANGE and p == a and not literal:
                    new.add((o, TYPE, b, False))
        if new <= known:
            return known
        known |= new


def table(spark, rows, graph=None):
    return spark.createDataFrame([(graph, s, "uri", p, o, "literal" if x else "uri", None, None, "d") for s, p, o, x in rows], quads.SCHEMA)


@pytest.mark.parametrize("seed, rules", [(1, e.RULES), (2, ("subclass",)), (3, ("subproperty", "range"))])
def test_entailment_is_the_fixed_point(spark, seed, rules):
    rng = random.Random(seed)
    name = lambda kind, n: f"urn:{kind}{rng.randrange(n)}"
    rows = {(name("c", 8), e.SUBCLASS, name("c", 8), False) for _ in range(8)} | {(name("p", 6), e.SUBPROPERTY, name("p", 6), False) for _ in range(5)}
    rows |= {(name("p", 6), e.DOMAIN, name("c", 8), False) for _ in range(2)} | {(name("p", 6), e.RANGE, name("c", 8), False) for _ in range(2)}
    rows |= {("urn:p0", e.SUBPROPERTY, e.SUBCLASS, False), ("urn:c1", "urn:p0", "urn:c2", False), ("urn:x", TYPE, "urn:c1", False)}
    rows |= {(name("x", 9), name("p", 6), name("x", 9), rng.random() < 0.3) for _ in range(14)} | {(name("x", 9), TYPE, name("c", 8), False) for _ in range(5)}
    got = e.entail(table(spark, sorted(rows)), rules)
    assert sorted((r.s, r.p, r.o, r.o_kind == "literal") for r in got.collect()) == sorted(fixed_point(rows, rules))
    assert got.where("doc_id = 'd'").count() == len(rows)


@pytest.mark.parametrize("seed, rules", [(4, e.RULES), (5, ("subclass", "domain")), (6, ("subproperty", "range")), (7, e.RULES)])
def test_a_schema_meets_the_other_statements_once(spark, monkeypatch, seed, rules):
    rng = random.Random(seed)
    name = lambda kind, n: f"urn:{kind}{rng.randrange(n)}"
    rows = {(f"urn:c{k}", e.SUBCLASS, f"urn:c{k // 2}", False) for k in range(2, 40)} | {(name("p", 6), e.SUBPROPERTY, name("p", 6), False) for _ in range(5)}
    rows |= {(name("p", 6), e.DOMAIN, name("c", 40), False) for _ in range(3)} | {(name("p", 6), e.RANGE, name("c", 40), False) for _ in range(3)}
    rows |= {(e.SUBCLASS, e.DOMAIN, "urn:c9", False), (e.RANGE, e.SUBPROPERTY, "urn:p1", False), ("urn:x", TYPE, "urn:c9", True)}
    rows |= {(name("x", 90), name("p", 6), name("x", 90), rng.random() < 0.3) for _ in range(90)} | {(name("x", 90), TYPE, name("c", 40), False) for _ in range(60)}
    written, plain = [], e.cut

    def counted(df):
        out = plain(df)
        written.append(out.where(F.col("s").startswith("urn:x")).count() if "s" in out.columns else 0)
        return out

    monkeypatch.setattr(e, "cut", counted)
    got = [(r.s, r.p, r.o, r.o_kind == "literal") for r in e.entail(table(spark, sorted(rows)), rules).collect()]
    assert sorted(got) == sorted(fixed_point(rows, rules))
    assert sum(written) <= sum(r[0].startswith("urn:x") for r in got)  # each statement is written once, told or found


def test_entailment_of_long_chains_named_graphs_and_nothing(spark):
    chain = [(f"urn:c{k}", e.SUBCLASS, f"urn:c{k + 1}", False) for k in range(40)] + [("urn:x", TYPE, "urn:c0", False)]
    assert e.entail(table(spark, chain)).where(F.col("p") == TYPE).count() == 41
    with pytest.raises(RuntimeError):
        e.entail(table(spark, chain), most=3)
    assert e.entail(table(spark, chain, "urn:g")).count() == 41
    assert e.entail(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        e.entail(table(spark, []), ("sameAs",))


def test_modes_are_errors_unless_asked_for(spark):
    text = f"<urn:a> <{TYPE}> <urn:c> .\n<urn:c> <{e.SUBCLASS}> <urn:d> .\n"
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    build = lambda **o: graphs.build_graph(docs, "id", "text", "application/n-quads", **o)
    assert build().count() == 2 and build(mode="materialized", entail=True).count() == 3
    for options in ({"mode": "materialized"}, {"mode": "runtime", "entail": True}, {"mode": "owl", "entail": True}):
        with pytest.raises(NotImplementedError):
            build(**options)


def test_table_functions_agree_with_the_loaders_and_tell_errors(spark):
    table_functions.register(spark)
    text = '<urn:s> <urn:p> "a\\u0041\\\\n\\t\\"\\U0001F600"@en <urn:g> .\n_:b <urn:p> "1"^^<urn:int> .\r\n# no\n\nbroken\n<urn:s> <urn:p> "x"^^<http://www.w3.org/2001/XMLSchema#string> .\n'
    docs = spark.createDataFrame([("1", text), ("2", None), ("3", "")], "id string, text string")
    docs.createOrReplaceTempView("table_function_texts")
    got = spark.sql("SELECT id AS doc_id, s.* FROM table_function_texts, LATERAL n_quads_statements(text) s")
    right = quads.parse(quads.quad_set(docs, "text", "id")).select(*got.drop("error").columns)
    assert sorted(map(str, got.where("error is null").drop("error").collect())) == sorted(map(str, right.collect()))
    assert [r.error for r in got.where("error is not null").collect()] == ["malformed statement: broken"]
    told = spark.sql("""SELECT t.* FROM (VALUES ('<urn:a> <urn:b> .'), ('<urn:a> <urn:b> 1 .'), (null)) v(x), LATERAL turtle_statements(x) t""").collect()
    assert sum(r.error is not None for r in told) == 1 and [r.o for r in told if r.error is None] == ["1"]
    told = spark.sql("""SELECT t.* FROM (VALUES ('{'), ('{"@id": "urn:a", "urn:b": {"@id": "urn:c"}}'), ('{"@context": "urn:else"}')) v(x), LATERAL json_ld_statements(x) t""").collect()
    assert sum(r.error is not None for r in told) == 2 and [(r.s, r.o, r.o_kind) for r in told if r.error is None] == [("urn:a", "urn:c", "uri")]


def test_a_literal_keeps_a_null_character_and_escaped_backslashes(spark):
    values = ["x\x00y", "\\n", "\\\\t\n", 'q"\\', "\x00\\\x00", "\\u0041 is A"]
    escape = lambda v: v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    rows = [("d", f'<urn:s> <urn:p{k}> "{escape(v)}" .') for k, v in enumerate(values)]
    got = quads.parse(spark.createDataFrame(rows, "doc_id string, quad string"))
    assert {r.p: r.o for r in got.collect()} == {f"urn:p{k}": v for k, v in enumerate(values)}


def test_nested_entries_imports_and_json_literals(spark):
    registry = {"urn:ctx": {"@context": {"@vocab": "urn:v:", "data": {"@type": "@json"}, "name": "urn:else"}}, "urn:twice": {"@context": {"@import": "urn:ctx"}}}
    context = {"@version": 1.1, "@import": "urn:ctx", "labels": "@nest", "name": "urn:n"}
    docs = [
        {"@context": context, "@id": "urn:a", "labels": [{"name": "x", "labels": {"other": "y"}}, {"@type": "T"}], "data": {"b": [1.0, None, "é"], "a": {}}},
        {"@id": "urn:b", "@nest": {"urn:p": {"@value": [True, 1e21], "@type": "@json"}}, "urn:q": {"@value": None, "@type": "@json"}},
        {"@context": context, "@id": "urn:c", "data": None},
        {"@context": {"@import": "urn:missing"}, "@id": "urn:d"},
        {"@context": {"@import": "urn:twice"}, "@id": "urn:d"},
        {"@id": "urn:e", "@nest": "text"},
        {"@id": "urn:e", "@nest": {"@value": 1}},
        {"@context": context, "@id": "urn:f", "data": [1, 2]},
    ]
    import json

    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "id long, text string")
    got = {(r.s, r.p, r.o, r.o_dt) for r in graphs.load_json_ld(df, "id", "text", registry=registry).collect()}
    kind = "http://www.w3.org/1999/02/22-rdf-syntax-ns#JSON"
    assert got == {
        ("urn:a", "urn:n", "x", None), ("urn:a", "urn:v:other", "y", None), ("urn:a", TYPE, "urn:v:T", None), ("urn:a", "urn:v:data", '{"a":{},"b":[1,null,"é"]}', kind),
        ("urn:b", "urn:p", "[true,1e+21]", kind), ("urn:b", "urn:q", "null", kind), ("urn:c", "urn:v:data", "null", kind), ("urn:f", "urn:v:data", "[1,2]", kind),
    }
    assert [r.doc_id for r in graphs.load_errors(df, "id", "text", registry=registry).orderBy("doc_id").collect()] == [3, 4, 5, 6]
