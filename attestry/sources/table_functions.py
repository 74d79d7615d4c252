"""Table functions for SQL: the statements of a document's text, in a lateral join.

    SELECT d.id, s.* FROM docs d, LATERAL turtle_statements(d.text) s WHERE s.error IS NULL

A document that cannot be read gives one row with the error, and so does each malformed line of N-Quads. Null
texts give nothing. Blank nodes have the names of their document; join on its id to tell them apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from attestry.functions.terms import XSD
from attestry.operators.quads import LINE, LITERAL
from attestry.sources import graphs, rdfxml, turtle

COLUMNS = "graph string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string, error string"
PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}
_LINE, _LITERAL = re.compile(LINE), re.compile(rf"({LITERAL})(?:\^\^<([^>]*)>|@(.+))?$")
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)")


def plain(text: str) -> str:
    """A text without its escapes."""
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else PLAIN.get(m[1], m[1]), text) if "\\" in text else text


def _node(token: str) -> tuple[str, str]:
    return (plain(token[1:-1]), "uri") if token.startswith("<") else (token[2:], "bnode")


def statement(line: str) -> tuple | None:
    """The parts of one line in the order of ``COLUMNS``, null for a line that is no statement."""
    m = _LINE.match(line)
    if not m:
        return None
    s, p, o, g = m.groups()
    literal = _LITERAL.match(o)
    value, kind, dt, lang = (plain(literal[1][1:-1]), "literal", literal[2], literal[3]) if literal else (*_node(o), None, None)
    return (_node(g)[0] if g else None, *_node(s), _node(p)[0], value, kind, None if dt == f"{XSD}string" else dt, lang, None)


def n_quads_lines(text: str) -> list[str]:
    """The lines of a text that are no comments, each once."""
    return list(dict.fromkeys(x for x in (y.replace("\r", "").strip(" ") for y in text.split("\n")) if x and not x.startswith("#")))


def _failed(message: str) -> tuple:
    return (*[None] * 8, message[:200])


def _function(lines: Callable[[str], list[str]]) -> type:
    class Statements:
        def eval(self, text: str) -> Iterator[tuple]:
            if text is None:
                return
            try:
                told = lines(text)
            except (ValueError, TypeError, AttributeError, RecursionError) as e:
                yield _failed(str(e))
                return
            for line in told:
                yield statement(line) or _failed(f"malformed statement: {line}")

    return Statements


def register(spark: SparkSession, registry: dict[str, dict] | None = None, base: str | None = None) -> None:
    """Makes ``n_quads_statements``, ``turtle_statements``, ``trig_statements``, ``rdf_xml_statements`` and ``json_ld_statements`` known to SQL.

    ``registry`` holds the contexts that JSON-LD documents may name, ``base`` what relative addresses are taken on.
    """
    known = registry or {}
    for name, lines in {
        "n_quads": n_quads_lines,
        "turtle": lambda text: turtle.lines_of(text, base, False),
        "trig": lambda text: turtle.lines_of(text, base, True),
        "rdf_xml": lambda text: list(rdfxml.lines_of(text, base)),
        "json_ld": lambda text: graphs.lines_of(text, known, base),
    }.items():
        spark.udtf.register(f"{name}_statements", F.udtf(_function(lines), returnType=COLUMNS, useArrow=True))
