"""Statements: reading and writing N-Quads text, patches and differences of sets, tables as graphs."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from attestry.functions.terms import XSD

SCHEMA = "graph string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string, doc_id string"
#: An address and one line of N-Quads; subject, predicate, object, graph.
_CODE = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
ADDRESS = r"<(?:[^\x00-\x20<>\"{}|^`\\]|" + _CODE + r")*+>"
LITERAL = r'"(?:[^"\\\n\r]|\\[tbnrf"\'\\]|' + _CODE + r')*+"'
NODE = r'_:[^\s<>"]+'
LINE = rf"^\s*({ADDRESS}|{NODE})\s*({ADDRESS})\s*({ADDRESS}|{NODE}|{LITERAL}(?:\^\^{ADDRESS}|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?)\s*({ADDRESS}|{NODE})?\s*\.\s*(?:#.*)?$"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def lines(text: Column) -> Column:
    """The trimmed, non-empty, non-comment lines of a text, each once."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.trim(F.replace(x, F.lit("\r"), F.lit(""))))
    return F.array_distinct(F.filter(trimmed, lambda x: (x != "") & ~F.startswith(x, F.lit("#"))))


def quad_set(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """doc_id, quad: the set of statement lines of each document."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(lines(F.col(text_col))).alias("quad"))


def serialise(quads: DataFrame) -> DataFrame:
    """doc_id, text: sorted lines with an end of line each."""
    return quads.groupBy("doc_id").agg(F.concat(F.array_join(F.array_sort(F.collect_set("quad")), "\n"), F.lit("\n")).alias("text"))


def _node(x: Column) -> tuple[Column, Column]:
    return F.regexp_replace(x, r"^<|>$|^_:", ""), F.when(F.startswith(x, F.lit("<")), "uri").when(F.startswith(x, F.lit("_:")), "bnode").otherwise("literal")


@F.arrow_udf(StringType())
def _decoded(text: pa.Array) -> pa.Array:
    """Escapes of all kinds, those of code points included."""
    plain = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}

    def one(m: re.Match) -> str:
        return chr(int(m[1][1:], 16)) if len(m[1]) > 1 else plain.get(m[1], m[1])

    told = (x.as_py() for x in text)
    return pa.array([None if x is None else re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, x) for x in told], pa.string())


def _unescape(x: Column) -> Column:
    """The characters that an escaped text stands for; only texts with code points leave the built-in way."""
    coded = F.contains(x, F.lit("\\u")) | F.contains(x, F.lit("\\U"))

    def simple(part: Column) -> Column:
        for mark, plain in (('\\"', '"'), ("\\'", "'"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f")):
            part = F.replace(part, F.lit(mark), F.lit(plain))
        return part

    # Escaped backslashes part the text first, so that no other escape is seen across one.
    parts = F.array_join(F.transform(F.split(x, r"\\\\"), simple), "\\")
    return F.when(coded, _decoded(F.when(coded, x))).when(F.contains(x, F.lit("\\")), parts).otherwise(x)


def normal(token: Column) -> Column:
    """A part of a statement as canonical text has it: one way to escape each character, no xsd:string."""
    body = F.regexp_extract(token, rf"^({LITERAL})", 1)
    inner = _unescape(F.substring(body, F.lit(2), F.length(body) - 2))
    for plain, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        inner = F.replace(inner, F.lit(plain), F.lit(mark))
    kind = F.substring(token, F.length(body) + 1, F.lit(2**31 - 1))
    kind = F.when(kind == f"^^<{XSD}string>", "").when(F.contains(kind, F.lit("\\")), _unescape(kind)).otherwise(kind)
    literal = F.when(F.contains(token, F.lit("\\")) | F.endswith(token, F.lit(f"{XSD}string>")), F.concat(F.lit('"'), inner, F.lit('"'), kind)).otherwise(token)
    return F.when(F.startswith(token, F.lit('"')), literal).when(F.contains(token, F.lit("\\")), _unescape(token)).otherwise(token)


def malformed(quads: DataFrame) -> DataFrame:
    """doc_id, quad: the lines that are no statement."""
    return quads.where(~F.col("quad").rlike(LINE)).select("doc_id", "quad")


def parse(quads: DataFrame, strict: bool = False) -> DataFrame:
    """The statements of ``(doc_id, quad)`` lines.

    A malformed line raises with ``strict``; else it gives none, and ``malformed`` names it.
    """
    part = [F.regexp_extract("quad", LINE, k) for k in range(1, 5)]
    s, p, o, g = part
    body = F.regexp_extract(o, rf"^({LITERAL})", 1)
    body = F.substring(body, F.lit(2), F.length(body) - 2)
    kind = _node(o)[1]
    dt = F.nullif(F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1), F.lit(""))
    sound = F.col("quad").rlike(LINE)
    if strict:
        sound = F.when(sound, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("malformed statement: "), F.col("quad"))).cast("boolean"))

    def address(x: Column) -> Column:
        return F.when(F.contains(x, F.lit("\\")), _unescape(_node(x)[0])).otherwise(_node(x)[0])

    return quads.where(sound).select(
        F.nullif(address(g), F.lit("")).alias("graph"), address(s).alias("s"), _node(s)[1].alias("s_kind"), address(p).alias("p"),
        F.when(kind == "literal", _unescape(body)).otherwise(address(o)).alias("o"), kind.alias("o_kind"),
        F.when(kind == "literal", F.nullif(dt, F.lit(XSD + "string"))).alias("o_dt"),
        F.when(kind == "literal", F.nullif(F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1), F.lit(""))).alias("o_lang"), F.col("doc_id").cast("string").alias("doc_id"),
    )


def apply_patch(quads: DataFrame, ops: DataFrame) -> DataFrame:
    """The set of ``quad`` after ``ops`` (seq, op, quad) in order.

    Any op but ``add`` removes; removing what is absent does nothing. Only the last op on a statement
    matters, so ops on different statements need no order.
    """
    last = ops.groupBy("quad").agg(F.max_by("op", "seq").alias("op"))
    kept = quads.select("quad").distinct().join(last, "quad", "left_anti")
    return kept.unionByName(last.where("op = 'add'").select("quad"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """op, quad: what to remove from a and to add to it so that it becomes b."""
    a, b = a.select("quad").distinct(), b.select("quad").distinct()
    gone, new = a.join(b, "quad", "left_anti"), b.join(a, "quad", "left_anti")
    return gone.select(F.lit("remove").alias("op"), "quad").unionByName(new.select(F.lit("add").alias("op"), "quad"))


def triple_count(quads: DataFrame) -> DataFrame:
    """The number of different statements; the document that said them does not matter."""
    return quads.drop("doc_id").distinct().agg(F.count("*").alias("n"))


def by_subject(quads: DataFrame) -> DataFrame:
    """s, statements: predicates and objects of each subject, in order."""
    return quads.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("p", "o"))).alias("statements"))


def from_table(df: DataFrame, subject: Column, kind: str, literals: dict[str, Column], links: dict[str, Column], base: str, doc_id: str = "") -> DataFrame:
    """A relational table as statements: a type, a literal for each column, a link for each key.

    Nulls give no statement. Literals are typed by their column. Each predicate is a part of a union of its own, so that Spark reads only
    those that a pattern asks for, and knows how large they are.
    """
    types = {"int": "integer", "bigint": "integer", "smallint": "integer", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "timestamp": "dateTime"}
    none = F.lit(None).cast("string")
    rows = [(RDF_TYPE, F.lit(base + kind), "uri", None)]
    found = dict(df.select(*[c.alias(n) for n, c in literals.items()]).dtypes)
    for name, column in literals.items():
        dt = "decimal" if found[name].startswith("decimal") else types.get(found[name])
        rows.append((base + name, column.cast("string"), "literal", XSD + dt if dt else None))
    rows += [(base + name, column.cast("string"), "uri", None) for name, column in links.items()]

    def one(p: str, o: Column, o_kind: str, o_dt: str | None) -> DataFrame:
        told = df.select(none.alias("graph"), subject.cast("string").alias("s"), F.lit("uri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(o_kind).alias("o_kind"), F.lit(o_dt).cast("string").alias("o_dt"), none.alias("o_lang"), F.lit(doc_id).alias("doc_id"))
        return told.where("s is not null and o is not null")

    return reduce(DataFrame.unionByName, [one(*r) for r in rows])


def ordered(df: DataFrame, by: str, order: str) -> DataFrame:
    """Adds ``seq``, the place of a row within its group."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy(order)))
