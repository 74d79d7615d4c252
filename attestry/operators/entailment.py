"""What follows from a schema: subclasses, subproperties, domains and ranges, to a fixed point.

The schema comes first: each round joins what the round before has found with all that is known, on either side of a rule,
and keeps what is new. Chains of subclasses and subproperties double in length with every round. What the other statements lead to
is then made of them in one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators.quads import RDF_TYPE
from attestry.plans.durable import cut

#: The addresses of the schema's predicates.
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = (RDFS + x for x in ("subClassOf", "subPropertyOf", "domain", "range"))
SCHEMA = (SUBCLASS, SUBPROPERTY, DOMAIN, RANGE)
RULES = ("subclass", "subproperty", "domain", "range")
PARTS = ["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]


def _links(rows: DataFrame, predicate: str) -> DataFrame:
    """a, b: subjects and objects of one schema predicate; the address a may be any predicate's or class's."""
    told = rows.where((F.col("p") == predicate) & (F.col("s_kind") == "uri") & (F.col("o_kind") != "literal"))
    return told.select(F.col("s").alias("a"), F.col("o").alias("b"), F.col("o_kind").alias("b_kind"))


def _statement(s: Column, s_kind: Column, p: Column, o: Column, o_kind: Column, o_dt: Column | None = None, o_lang: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("string")
    return [c.alias(n) for c, n in zip((s, s_kind, p, o, o_kind, none if o_dt is None else o_dt, none if o_lang is None else o_lang), PARTS)]


def _consequences(rows: DataFrame, schema: DataFrame, rules: tuple[str, ...]) -> list[DataFrame]:
    """What each rule makes of statements on its one side and schema statements on its other."""
    c, kind = F.col, F.lit(RDF_TYPE)
    out = []
    if "subclass" in rules:
        up = _links(schema, SUBCLASS)
        typed = rows.where((c("p") == RDF_TYPE) & (c("o_kind") == "uri")).join(up, c("o") == c("a"))
        out.append(typed.select(*_statement(c("s"), c("s_kind"), kind, c("b"), c("b_kind"))))
        chain = rows.where((c("p") == SUBCLASS) & (c("o_kind") == "uri")).join(up, c("o") == c("a"))
        out.append(chain.select(*_statement(c("s"), c("s_kind"), F.lit(SUBCLASS), c("b"), c("b_kind"))))
    if "subproperty" in rules:
        up = _links(schema, SUBPROPERTY)
        out.append(rows.join(up.where("b_kind = 'uri'"), c("p") == c("a")).select(*_statement(c("s"), c("s_kind"), c("b"), c("o"), c("o_kind"), c("o_dt"), c("o_lang"))))
        chain = rows.where((c("p") == SUBPROPERTY) & (c("o_kind") == "uri")).join(up, c("o") == c("a"))
        out.append(chain.select(*_statement(c("s"), c("s_kind"), F.lit(SUBPROPERTY), c("b"), c("b_kind"))))
    if "domain" in rules:
        out.append(rows.join(_links(schema, DOMAIN), c("p") == c("a")).select(*_statement(c("s"), c("s_kind"), kind, c("b"), c("b_kind"))))
    if "range" in rules:
        out.append(rows.where("o_kind <> 'literal'").join(_links(schema, RANGE), c("p") == c("a")).select(*_statement(c("o"), c("o_kind"), kind, c("b"), c("b_kind"))))
    return out


def entail(table: DataFrame, rules: tuple[str, ...] = RULES, most: int = 64) -> DataFrame:
    """The statements with all that follow from those of the default graph, which are told once each, without a document.

    ``rules`` are some of ``RULES``. Statements of named graphs stay as they are and take no part. A literal has
    no type by a range. Raises where ``most`` rounds do not suffice.

    The schema's statements come to their fixed point first. All others then meet it in one pass, unless it says something of types, or
    of the schema's own predicates, that lets what follows lead on: rounds over all statements do that.
    """
    unknown = set(rules) - set(RULES)
    if unknown:
        raise ValueError(f"no rules: {sorted(unknown)}")
    told = cut(table.where("graph is null").select(*PARTS))
    laws = _fixed_point(cut(told.where(F.col("p").isin(*SCHEMA)).distinct()), rules, most)
    leads_on = ((F.col("p") == SUBPROPERTY) & F.col("o").isin(RDF_TYPE, *SCHEMA)) | ((F.col("s") == RDF_TYPE) & F.col("p").isin(*SCHEMA))
    if laws.where(leads_on).isEmpty():
        found = reduce(DataFrame.unionByName, _pass(told, laws, rules), laws)
    else:
        found = _fixed_point(cut(told.distinct()), rules, most)
    more = cut(_new(found, told))
    none = F.lit(None).cast("string")
    return table.unionByName(more.select(none.alias("graph"), *PARTS, none.alias("doc_id")).select(*table.columns))


def _fixed_point(told: DataFrame, rules: tuple[str, ...], most: int) -> DataFrame:
    """Statements, each told once, with all that follow from them, in rounds over all that is known."""
    known, fresh, first = told, told, True
    for _ in range(most):
        is_schema = F.col("p").isin(*SCHEMA)
        old, new = known.where(is_schema), fresh.where(is_schema)
        made = _consequences(fresh, old, rules)
        if not first and not new.isEmpty():  # a schema statement that has just been found meets all that is known
            made += _consequences(known, new, rules)
        found = reduce(DataFrame.unionByName, made).distinct()
        fresh = cut(_without(found, known))
        if fresh.isEmpty():
            return known
        known, first = cut(known.unionByName(fresh)), False
    raise RuntimeError(f"no fixed point after {most} rounds")


def _pass(rows: DataFrame, laws: DataFrame, rules: tuple[str, ...]) -> list[DataFrame]:
    """All that follows from statements by a schema that is at its fixed point, of which none leads on to another.

    A predicate has its superproperties, and classes of its subjects and objects by any of these, with all superclasses; a class has its
    superclasses. Both are tables of the schema's size, so that each statement meets them once.
    """
    c, out = F.col, []
    above = _links(laws, SUBCLASS) if "subclass" in rules else None
    up = _links(laws, SUBPROPERTY).where("b_kind = 'uri'") if "subproperty" in rules else None
    told = [] if up is None else [up.withColumn("place", F.lit("p"))]
    for rule, predicate, place in (("domain", DOMAIN, "s"), ("range", RANGE, "o")):
        if rule not in rules:
            continue
        classes = _links(laws, predicate)
        if up is not None:
            classes = classes.unionByName(up.select("a", c("b").alias("q")).join(classes.withColumnRenamed("a", "q"), "q").drop("q"))
        if above is not None:
            classes = classes.unionByName(classes.where("b_kind = 'uri'").select(c("a").alias("q"), c("b").alias("a")).join(above, "a").select(c("q").alias("a"), "b", "b_kind"))
        told.append(classes.withColumn("place", F.lit(place)))
    if told:
        met = rows.join(cut(reduce(DataFrame.unionByName, told).distinct()), c("p") == c("a")).where("place <> 'o' or o_kind <> 'literal'")
        at, as_p = (lambda x: c("place") == x), c("place") == "p"
        s, s_kind = (F.when(at("o"), c(o)).otherwise(c(x)) for x, o in (("s", "o"), ("s_kind", "o_kind")))
        o, o_kind = (F.when(as_p, c(x)).otherwise(c(b)) for x, b in (("o", "b"), ("o_kind", "b_kind")))
        out.append(met.select(*_statement(s, s_kind, F.when(as_p, c("b")).otherwise(RDF_TYPE), o, o_kind, F.when(as_p, c("o_dt")), F.when(as_p, c("o_lang")))))
    if above is not None:
        typed = rows.where((c("p") == RDF_TYPE) & (c("o_kind") == "uri")).join(cut(above.distinct()), c("o") == c("a"))
        out.append(typed.select(*_statement(c("s"), c("s_kind"), F.lit(RDF_TYPE), c("b"), c("b_kind"))))
    return out


def _new(found: DataFrame, told: DataFrame) -> DataFrame:
    """The rows of the one that the other lacks, once each; nulls equal nulls."""
    both = found.select(*PARTS, F.lit(False).alias("__told")).unionByName(told.select(*PARTS, F.lit(True).alias("__told")))
    return both.groupBy(*PARTS).agg(F.max("__told").alias("__told")).where(~F.col("__told")).drop("__told")


def _without(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of a that b lacks; nulls equal nulls."""
    right = b.select(*[F.col(p).alias(f"__{p}") for p in PARTS])
    return a.join(right, reduce(lambda x, y: x & y, (F.col(p).eqNullSafe(F.col(f"__{p}")) for p in PARTS)), "left_anti")
