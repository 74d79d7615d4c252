"""The stored statement table: what its plans open and shuffle, and that it answers as the plain table does."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from attestry.operators import patterns, quads
from attestry.operators.patterns import Literal, Var
from attestry.sources import statements

X, Y, N = Var("x"), Var("y"), Var("n")
B = "urn:t:"


def table(spark):
    rows = []
    for k in range(60):
        rows += [(None, f"{B}p{k}", "uri", quads.RDF_TYPE, f"{B}Person", "uri", None, None, "d"), (None, f"{B}p{k}", "uri", f"{B}name", f"n{k % 7}", "literal", None, "en" if k % 2 else None, "d")]
        rows += [(None, f"{B}p{k}", "uri", f"{B}knows", f"{B}p{(k * 7 + 1) % 60}", "uri", None, None, "d"), (None, "b0", "bnode", f"{B}name", f"n{k % 7}", "literal", f"{B}t", None, f"d{k}")]
        rows += [(f"{B}g", f"{B}p{k}", "uri", f"{B}name", "hidden", "literal", None, None, "d")]
    return spark.createDataFrame(rows, quads.SCHEMA)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def fresh() -> str:
    return f"t_{uuid.uuid4().hex}"


QUERIES = [
    [(X, "a", f"{B}Person"), (X, f"{B}name", N), (X, f"{B}knows", Y)],
    [(X, f"{B}knows", Y), (Y, f"{B}name", N)],
    [(X, f"{B}name", Literal("n3", None, "en"))],
    [(X, f"{B}name", Literal("n3"))],
    [(f"{B}p3", Var("p"), Y)],
    [(X, f"{B}knows", X)],
    [(X, f"{B}missing", Y), (X, f"{B}name", N)],
    [(f"{B}p3", f"{B}knows", f"{B}p22"), (X, f"{B}name", N)],
]


@pytest.mark.parametrize("bits", [64, 4])
def test_a_store_answers_as_the_plain_table(spark, tmp_path, bits):
    plain = table(spark)
    store = statements.save(plain, str(tmp_path / "kg"), fresh(), buckets=4, bits=bits)
    assert store.terms.count() == store.terms.select("id").distinct().count() == store.terms.select("kind", "value", "dt", "lang").distinct().count()
    for triples in QUERIES:
        right = patterns.bgp(plain.drop("doc_id").distinct().withColumn("doc_id", F.lit("")), triples)
        got = statements.named(store, statements.bgp(store, triples)).select(*right.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, right.collect())), triples
    columns = [c for c in plain.columns if c != "doc_id"]
    assert sorted(map(str, statements.statements(store).select(columns).collect())) == sorted(map(str, plain.select(columns).distinct().collect()))


def test_patterns_open_their_predicate_and_stars_need_no_shuffle(spark, tmp_path):
    store = statements.save(table(spark), str(tmp_path / "kg"), fresh(), buckets=4)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        star = plan(statements.bgp(store, QUERIES[0]))
        assert "Exchange" not in star and star.count("SortMergeJoin") == 2
        assert star.count("PartitionFilters: [isnotnull(p#") == 3 and star.count("SelectedBucketsCount: 4 out of 4") == 3
        one = statements.bgp(store, [(f"{B}p3", f"{B}name", N)])
        assert "EqualTo(s," in plan(one) and "PartitionFilters: [isnotnull(p#" in plan(one)
        assert "Exchange" in plan(statements.bgp(store, QUERIES[1]))  # another variable than the subject
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_a_store_is_opened_again(spark, tmp_path):
    folder = str(tmp_path / "kg")
    first = statements.save(table(spark), folder, fresh(), buckets=4)
    n = first.facts.count()
    statements.drop(first)
    again = statements.load(spark, folder, fresh())
    assert again.facts.count() == n and statements.bgp(again, QUERIES[0]).count() == 60
    with pytest.raises(Exception):
        statements.save(table(spark), folder, fresh())


def test_a_store_of_nothing(spark, tmp_path):
    store = statements.save(spark.createDataFrame([], quads.SCHEMA), str(tmp_path / "kg"), fresh(), buckets=2)
    assert statements.bgp(store, QUERIES[0]).count() == 0 and statements.named(store, statements.bgp(store, [(X, Var("p"), Y)])).count() == 0


def test_a_pattern_over_tables_reads_only_what_says_its_predicate(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", 2.5), (2, None, 1.0), (None, "y", 3.0)], "k long, name string, size double")
    b = spark.createDataFrame([(1, 1)], "k long, of long")
    for name, df in (("a", a), ("b", b)):
        df.write.parquet(str(tmp_path / name))
    a, b = (spark.read.parquet(str(tmp_path / x)) for x in "ab")
    iri = lambda c: F.concat(F.lit("urn:"), c)
    whole = quads.from_table(a, iri(F.col("k")), "A", {"name": F.col("name"), "size": F.col("size")}, {}, "urn:v:").unionByName(quads.from_table(b, iri(F.col("k")), "B", {}, {"of": iri(F.col("of"))}, "urn:v:"))
    told = [(r.s, r.p.removeprefix("urn:v:"), r.o, r.o_kind, r.o_dt and r.o_dt.split("#")[1]) for r in whole.collect()]
    kind = quads.RDF_TYPE
    assert sorted(told, key=str) == sorted([("urn:1", kind, "urn:v:A", "uri", None), ("urn:2", kind, "urn:v:A", "uri", None), ("urn:1", "name", "x", "literal", None), ("urn:1", "size", "2.5", "literal", "double"),
        ("urn:2", "size", "1.0", "literal", "double"), ("urn:1", kind, "urn:v:B", "uri", None), ("urn:1", "of", "urn:1", "uri", None)], key=str)
    found = patterns.bgp(whole, [(patterns.Var("x"), "urn:v:of", patterns.Var("y"))])
    assert all("/b/" in f for f in found.inputFiles()) and found.count() == 1


def test_terms_are_written_once_where_none_share_a_hash(spark, tmp_path, monkeypatch):
    written, plain = [], statements.cut

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(statements, "cut", counted)
    quads_ = table(spark)
    store = statements.save(quads_.unionByName(quads_), str(tmp_path / "kg"), f"kg_{uuid.uuid4().hex}", buckets=4)
    assert sum(written) == 0  # without terms of one hash nothing is written beside the two tables
    assert store.facts.count() == quads_.drop("doc_id").distinct().count() and store.terms.select("id").distinct().count() == store.terms.count()
    found = {tuple(r) for r in statements.statements(store).drop("doc_id").collect()}
    assert found == {tuple(r) for r in quads_.drop("doc_id").collect()}
    statements.drop(store)
