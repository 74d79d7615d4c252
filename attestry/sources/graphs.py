"""Loading graphs: JSON-LD, Turtle, TriG and RDF/XML documents, N-Quads or N-Triples text as statement tables.

Contexts come from the document or from a registry that the caller hands over; nothing is fetched.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.jsondoc import canonical as canonical_text
from attestry.functions.jsondoc import number_text
from attestry.functions.terms import XSD
from attestry.operators import quads
from attestry.operators.quads import RDF_TYPE
from attestry.sources import rdfxml, turtle

#: The list vocabulary and the entailment modes.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
ENTAILMENT = ("none", "materialized", "runtime")
SUBCLASS = "http://www.w3.org/2000/01/rdf-schema#subClassOf"


class Context:
    """What the terms of a JSON-LD document stand for."""

    def __init__(self, registry: dict[str, dict], base: str | None = None) -> None:
        self.registry, self.base, self.vocab, self.language = registry, base, None, None
        self.terms: dict[str, dict] = {}

    def extended(self, told: object) -> Context:
        if told is None:
            return Context(self.registry, self.base)
        out = Context(self.registry, self.base)
        out.vocab, out.language, out.terms = self.vocab, self.language, dict(self.terms)
        for part in told if isinstance(told, list) else [told]:
            if isinstance(part, str):
                if part not in self.registry:
                    raise ValueError(f"context not in the registry: {part}")
                part = self.registry[part].get("@context", self.registry[part])
            if "@import" in part:  # what the context says itself goes before what it takes over
                name = part["@import"]
                taken = self.registry.get(name)
                taken = taken.get("@context", taken) if taken is not None else None
                if not isinstance(taken, dict) or "@import" in taken:
                    raise ValueError(f"no context to import: {name}")
                part = {**taken, **{k: v for k, v in part.items() if k != "@import"}}
            for key, value in part.items():
                if key in ("@vocab", "@base", "@language"):
                    setattr(out, key[1:], value)
                elif not key.startswith("@"):
                    out.terms[key] = value if isinstance(value, dict) else {"@id": value}
        return out

    def iri(self, name: str, vocab: bool = False, depth: int = 0) -> str | None:
        """The address that a term, a compact or a relative one stands for; None where it has none."""
        if name.startswith("@") or name.startswith("_:"):
            return name
        found = self.terms.get(name)
        if found is not None and (vocab or depth) and depth < 10:
            return self.iri(found.get("@id") or name, True, depth + 1) if found.get("@id") != name else name
        start, colon, rest = name.partition(":")
        if colon and not rest.startswith("//") and start in self.terms and depth < 10:
            return f"{self.iri(start, True, depth + 1)}{rest}"
        if colon:
            return name
        if vocab:
            return self.vocab + name if self.vocab else None
        return self.base + name if self.base else name


def held_in(value: object, told: dict, at: Context, blank: Callable[[], str]) -> list:
    """The values of a property, taken out of the container that its term stands for."""
    if told.get("@type") == "@json":
        return [value]
    kinds = told.get("@container") or []
    kinds = kinds if isinstance(kinds, list) else [kinds]
    if "@list" in kinds:
        return [value] if isinstance(value, dict) and "@list" in value else [{"@list": value if isinstance(value, list) else [value]}]
    by = next((k for k in ("@language", "@index", "@id", "@type") if k in kinds), None)
    if by and isinstance(value, dict):
        out = []
        for name, items in value.items():
            for x in items if isinstance(items, list) else [items]:
                none = at.iri(name, True) == "@none"
                if by == "@language":
                    x = {"@value": x, **({} if none else {"@language": name})}
                elif by == "@id" and not none:
                    x = {"@id": at.iri(name), "@graph": x} if "@graph" in kinds else {"@id": name, **x}
                elif by == "@type" and not none:
                    x = {"@id": x} if isinstance(x, str) else x
                    own = x.get("@type", [])
                    x = {**x, "@type": [name, *(own if isinstance(own, list) else [own])]}
                elif "@graph" in kinds:
                    x = {"@id": blank(), "@graph": x}
                out.append(x)
        return out
    items = value if isinstance(value, list) else [value]
    return [{"@id": blank(), "@graph": x} for x in items] if "@graph" in kinds else items


class Statements:
    """The statement lines of one JSON-LD document."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.nodes = 0

    def blank(self) -> str:
        self.nodes += 1
        return f"_:b{self.nodes - 1}"

    def say(self, s: str, p: str, o: str, graph: str | None) -> None:
        shown = [x if x.startswith(("_:", '"')) else f"<{x}>" for x in (s, p, o, *([graph] if graph else []))]
        self.out.append(" ".join(shown) + " .")

    def node(self, item: dict, at: Context, graph: str | None) -> str:
        at = at.extended(item["@context"]) if "@context" in item else at
        name = next((item[k] for k in item if at.iri(k, True) == "@id"), None)
        me = self.blank() if name is None else at.iri(name)
        self.entries(me, name is not None, item, at, graph)
        return me

    def entries(self, me: str, named: bool, item: dict, at: Context, graph: str | None) -> None:
        """What the entries of a node, or of a group of them (``@nest``), say about it."""
        for key, value in item.items():
            p = at.iri(key, True)
            if p == "@nest":
                for x in value if isinstance(value, list) else [value]:
                    if not isinstance(x, dict) or any(at.iri(k, True) == "@value" for k in x):
                        raise ValueError("@nest holds no entries")
                    self.entries(me, named, x, at, graph)
            elif p == "@type":
                for kind in value if isinstance(value, list) else [value]:
                    self.say(me, RDF_TYPE, at.iri(kind, True) or kind, graph)
            elif p == "@graph":
                inner = me if named else graph
                for x in value if isinstance(value, list) else [value]:
                    self.node(x, at, inner)
            elif p == "@included":
                for x in value if isinstance(value, list) else [value]:
                    self.node(x, at, graph)
            elif p == "@reverse":
                for k, x in value.items():
                    self.backwards(me, at.iri(k, True), x, at, graph)
            elif "@reverse" in at.terms.get(key, {}):
                self.backwards(me, at.iri(at.terms[key]["@reverse"], True), value, at, graph)
            elif p and not p.startswith("@") and ":" in p:
                told = at.terms.get(key, {})
                inner = at.extended(told["@context"]) if "@context" in told else at
                for x in held_in(value, told, inner, self.blank):
                    o = self.value(x, told, inner, graph)
                    if o is not None:
                        self.say(me, p, o, graph)

    def backwards(self, me: str, p: str | None, items: object, at: Context, graph: str | None) -> None:
        """Statements about ``me`` as the object, of the nodes that a reverse property holds."""
        for x in items if isinstance(items, list) else [items]:
            if p and ":" in p:
                self.say(self.node(x, at, graph) if isinstance(x, dict) else at.iri(x), p, me, graph)

    def value(self, x: object, told: dict, at: Context, graph: str | None) -> str | None:
        if told.get("@type") == "@json":
            return self.json_literal(x["@value"] if isinstance(x, dict) and "@value" in x and x.get("@type") == "@json" else x)
        if x is None:
            return None
        if isinstance(x, dict) and "@value" in x and x.get("@type") and at.iri(x["@type"], True) == "@json":
            return self.json_literal(x["@value"])
        if isinstance(x, dict):
            if "@list" in x:
                return self.chain(x["@list"] if isinstance(x["@list"], list) else [x["@list"]], told, at, graph)
            if "@value" not in x:
                return self.node(x, at, graph)
            if x["@value"] is None:
                return None
            return self.literal(x["@value"], at.iri(x["@type"], True) if x.get("@type") else None, x.get("@language"))
        kind = told.get("@type")
        if isinstance(x, str) and kind in ("@id", "@vocab"):
            return at.iri(x, kind == "@vocab")
        language = told.get("@language", at.language) if isinstance(x, str) and not kind else None
        return self.literal(x, at.iri(kind, True) if kind and not kind.startswith("@") else None, language)

    def chain(self, items: list, told: dict, at: Context, graph: str | None) -> str:
        head = f"{RDF}nil"
        for x in reversed(items):
            o = self.value(x, told, at, graph)
            if o is not None:
                link = self.blank()
                self.say(link, f"{RDF}first", o, graph)
                self.say(link, f"{RDF}rest", head, graph)
                head = link
        return head

    @classmethod
    def json_literal(cls, x: object) -> str:
        """A JSON literal: the canonical text of the value."""
        return cls.literal(canonical_text(x), f"{RDF}JSON", None)

    @staticmethod
    def literal(x: object, kind: str | None, language: str | None) -> str:
        if isinstance(x, bool):
            x, kind = str(x).lower(), kind or XSD + "boolean"
        elif isinstance(x, (int, float)):
            whole = float(x).is_integer() and abs(x) < 1e21 and kind != XSD + "double"
            x, kind = (number_text(x), kind or XSD + "integer") if whole else (double_text(x), kind or XSD + "double")
        for plain, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
            x = str(x).replace(plain, mark)
        return f'"{x}"' + (f"@{language.lower()}" if language else f"^^<{kind}>" if kind and kind != XSD + "string" else "")


def double_text(x: float) -> str:
    """The canonical lexical form of a double: one digit before the point, an exponent."""
    digits, power = f"{float(x):.15E}".split("E")
    digits = digits.rstrip("0")
    return f"{digits}{'0' if digits.endswith('.') else ''}E{int(power)}"


def lines_of(text: str, registry: dict[str, dict], base: str | None) -> list[str]:
    document = json.loads(text)
    said = Statements()
    for item in document if isinstance(document, list) else [document]:
        said.node(item, Context(registry, base), None)
    return list(dict.fromkeys(said.out))


def json_ld_lines(docs: DataFrame, id_col: str, text_col: str, registry: dict[str, dict] | None = None, base: str | None = None, strict: bool = False) -> DataFrame:
    """doc_id, quad, error: the statement lines of JSON-LD documents, of any size.

    A document that is no JSON or names a context outside the registry gives one row with the error, or
    raises with ``strict``. Null documents give nothing.
    """
    known = registry or {}
    return _each(docs, id_col, text_col, lambda text: lines_of(text, known, base), strict)


def turtle_lines(docs: DataFrame, id_col: str, text_col: str, base: str | None = None, named_graphs: bool = False, strict: bool = False) -> DataFrame:
    """doc_id, quad, error: the statement lines of Turtle documents, or of TriG ones with ``named_graphs``.

    A document that is not well formed gives one row with the error, or raises with ``strict``. Null
    documents give nothing.
    """
    return _each(docs, id_col, text_col, lambda text: turtle.lines_of(text, base, named_graphs), strict)


def rdf_xml_lines(docs: DataFrame, id_col: str, text_col: str, base: str | None = None, strict: bool = False) -> DataFrame:
    """doc_id, quad, error: the statement lines of RDF/XML documents. Errors and nulls as in ``turtle_lines``."""
    return _each(docs, id_col, text_col, lambda text: list(rdfxml.lines_of(text, base)), strict)


def _each(docs: DataFrame, id_col: str, text_col: str, lines: Callable[[str], list[str]], strict: bool) -> DataFrame:
    """The lines that a function gives for each document, or its error."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out, errors = [], [], []
            for k, text in enumerate(batch["text"].to_pylist()):
                if text is None:
                    continue
                try:
                    told = lines(text)
                    row += [k] * len(told)
                    out += told
                    errors += [None] * len(told)
                except (ValueError, TypeError, AttributeError, RecursionError) as e:
                    if strict:
                        raise ValueError(f"document {batch['doc_id'][k].as_py()!r}: {str(e)[:200]}") from e
                    row, out, errors = [*row, k], [*out, None], [*errors, str(e)[:200]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(row, pa.int64())), pa.array(out, pa.string()), pa.array(errors, pa.string())], ["doc_id", "quad", "error"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(load, f"doc_id {kind}, quad string, error string")


def load_json_ld(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """The statement table of JSON-LD documents; blank nodes are told apart by document.

    Documents with an error have no statements: ``load_errors`` names them, ``strict`` raises.
    """
    return scoped(quads.parse(json_ld_lines(docs, id_col, text_col, **options).where("error is null")))


def load_turtle(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """The statement table of Turtle or TriG documents; blank nodes are told apart by document. Errors as in ``load_json_ld``."""
    return scoped(quads.parse(turtle_lines(docs, id_col, text_col, **options).where("error is null")))


def load_rdf_xml(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """The statement table of RDF/XML documents; blank nodes are told apart by document. Errors as in ``load_json_ld``."""
    return scoped(quads.parse(rdf_xml_lines(docs, id_col, text_col, **options).where("error is null")))


def load_errors(docs: DataFrame, id_col: str, text_col: str, media: str = "application/ld+json", **options) -> DataFrame:
    """doc_id, error: the documents that the table of their media type holds no statement of."""
    if media == "application/ld+json":
        lines = json_ld_lines(docs, id_col, text_col, **options)
    elif media == "application/rdf+xml":
        lines = rdf_xml_lines(docs, id_col, text_col, **options)
    elif media in ("application/n-quads", "application/n-triples"):
        broken = quads.malformed(quads.quad_set(docs, text_col, id_col))
        return broken.groupBy("doc_id").agg(F.concat(F.lit("malformed statement: "), F.min("quad")).alias("error"))
    elif media in ("text/turtle", "application/trig"):
        lines = turtle_lines(docs, id_col, text_col, named_graphs=media == "application/trig", **options)
    else:
        raise ValueError(f"no errors are told for {media}")
    return lines.where("error is not null").select("doc_id", "error")


def load_n_quads(docs: DataFrame, id_col: str, text_col: str, strict: bool = False) -> DataFrame:
    """The statement table of N-Quads or N-Triples texts.

    A malformed line raises with ``strict``; else its document has no statements, and ``load_errors`` names it.
    """
    lines = quads.quad_set(docs, text_col, id_col)
    if not strict:
        lines = lines.join(quads.malformed(lines).select("doc_id").distinct(), "doc_id", "left_anti")
    return scoped(quads.parse(lines, strict))


def scoped(table: DataFrame) -> DataFrame:
    """Blank nodes named after their document, so that graphs of many documents can be queried as one."""
    for place in ("s", "o"):
        own = F.concat("doc_id", F.lit("/"), place)
        table = table.withColumn(place, F.when(F.col(f"{place}_kind") == "bnode", own).otherwise(F.col(place)))
    return table


def entailment_mode(stated: str | None) -> str:
    return stated or "none"


def build_graph(docs: DataFrame, id_col: str, text_col: str, media: str = "application/ld+json", mode: str | None = None, entail: bool = False, **options) -> DataFrame:
    """The statement table of documents of one media type.

    Entailment modes other than ``none`` raise, unless ``entail`` is set: then ``materialized`` adds all that follows from
    the documents' schema (see ``entailment.entail``), and ``runtime`` is no mode of tables.
    A document in JSON-LD, RDF/XML or N-Quads with an error raises, unless ``strict`` is false; one in Turtle or TriG with ``strict``.
    """
    mode = entailment_mode(mode)
    if mode == "materialized" and entail:
        from attestry.operators import entailment

        return entailment.entail(build_graph(docs, id_col, text_col, media, **options))
    if mode != "none":
        raise NotImplementedError(f"entailment mode {mode}: not asked for" if mode in ENTAILMENT else f"unknown entailment mode {mode}")
    if media == "application/ld+json":
        return load_json_ld(docs, id_col, text_col, **{"strict": True, **options})
    if media in ("application/n-quads", "application/n-triples"):
        return load_n_quads(docs, id_col, text_col, **{"strict": True, **options})
    if media == "application/rdf+xml":
        return load_rdf_xml(docs, id_col, text_col, **{"strict": True, **options})
    if media in ("text/turtle", "application/trig"):
        return load_turtle(docs, id_col, text_col, named_graphs=media == "application/trig", **options)
    raise ValueError(f"no reader for {media}")


def subclass_closure(table: DataFrame) -> DataFrame:
    """The statements with the types that follow from subclasses of subclasses, each once."""
    from attestry.operators import patterns

    up = patterns.one_or_more(patterns.steps(table, [SUBCLASS])).select(F.col("x.value").alias("o"), F.col("y.value").alias("up"))
    typed = table.where(F.col("p") == RDF_TYPE)
    more = typed.join(up, "o").select(*[F.col("up").alias("o") if c == "o" else F.col(c) for c in table.columns])
    return table.unionByName(more).distinct()
