"""Reading Turtle and TriG: statement lines of one document, for the loader of graphs.

A document is cut into tokens once; a statement is a subject and lists of predicates and objects. TriG
adds graph blocks. Nested blank nodes and collections are named ``_:g0`` and on in order of the text, the
names that the document gives itself are kept with a ``u`` in front.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

from attestry.functions.terms import XSD

#: The vocabulary of types and lists, and the escapes of strings.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
NAME = r"(?:[\w·-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?#@%-]|:)"
TOKENS = re.compile(
    r"""(?P<skip>\s+|\#[^\n\r]*)
    |(?P<iri><[^\x00-\x20<>"{}|^`]*>)
    |(?P<long>\"{3}(?:\"{0,2}(?:[^"\\]|\\.))*\"{3}|'{3}(?:'{0,2}(?:[^'\\]|\\.))*'{3})
    |(?P<short>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<blank>_:\w(?:[\w.·-]*[\w·-])?)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[^\W\d_][\w·.-]*)?:(?:NAME(?:(?:NAME|\.)*NAME)?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>\^\^|[.;,\[\](){}])""".replace("NAME", NAME),
    re.VERBOSE | re.DOTALL,
)


def plain(text: str) -> str:
    """A string with its escapes resolved."""

    def one(m: re.Match) -> str:
        code = m.group(1)
        if code[0] in "uU":
            return chr(int(code[1:], 16))
        if code not in ESCAPES:
            raise ValueError(f"unknown escape \\{code}")
        return ESCAPES[code]

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.DOTALL)


def quoted(text: str) -> str:
    for raw, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = text.replace(raw, mark)
    return f'"{text}"'


class Reader:
    """The statements of one document; raises ValueError where it is not well formed."""

    def __init__(self, text: str, base: str | None, graphs: bool) -> None:
        self.base, self.graphs, self.prefixes = base, graphs, {}
        self.out: list[str] = []
        self.graph, self.nodes, self.at = "", 0, 0
        self.tokens: list[tuple[str, str]] = []
        place = 0
        while place < len(text):
            m = TOKENS.match(text, place)
            if m is None:
                raise ValueError(f"unreadable at {place}: {text[place:place + 20]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m.group()))
            place = m.end()
        self.tokens.append(("end", ""))

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def take(self, mark: str) -> bool:
        hit = self.peek() == ("mark", mark)
        self.at += hit
        return hit

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise ValueError(f"expected {mark!r}, found {self.peek()[1]!r}")

    def fresh(self) -> str:
        self.nodes += 1
        return f"_:g{self.nodes - 1}"

    def say(self, s: str, p: str, o: str) -> None:
        self.out.append(f"{s} {p} {o}{self.graph} .")

    def read(self) -> list[str]:
        while self.peek()[0] != "end":
            kind, told = self.peek()
            if told.lower() in ("@prefix", "@base", "prefix", "base") and kind in ("at", "word"):
                self.directive()
            elif self.graphs and (told == "{" or (kind == "word" and told.upper() == "GRAPH")):
                self.at += told != "{"
                self.block("" if told == "{" else f" {self.node()}")
            else:
                self.triples(top=True)
        return list(dict.fromkeys(self.out))

    def directive(self) -> None:
        told = self.next()[1]
        if told.lower().endswith("prefix"):
            name = self.next()[1]
            if not name.endswith(":"):
                raise ValueError(f"no prefix: {name!r}")
            self.prefixes[name[:-1]] = self.address()
        else:
            self.base = self.address()
        if told.startswith("@"):
            self.need(".")

    def address(self) -> str:
        kind, told = self.next()
        if kind != "iri":
            raise ValueError(f"expected an address, found {told!r}")
        found = plain(told[1:-1])
        return found if re.match(r"[A-Za-z][\w+.-]*:", found) or not self.base else urljoin(self.base, found)

    def block(self, graph: str) -> None:
        self.need("{")
        self.graph = graph
        while not self.take("}"):
            self.triples(top=False)
        self.graph = ""

    def triples(self, top: bool) -> None:
        nested = self.peek() == ("mark", "[")
        subject = self.node()
        if top and self.graphs and self.peek() == ("mark", "{"):
            return self.block(f" {subject}")
        # a node with properties of its own may stand alone
        if not (nested and self.peek()[1] in (".", "}")):
            self.properties(subject)
        if not self.take(".") and (top or self.peek() != ("mark", "}")):
            raise ValueError(f"expected '.', found {self.peek()[1]!r}")

    def properties(self, subject: str) -> None:
        while True:
            if self.peek() == ("word", "a"):
                self.at += 1
                predicate = f"<{RDF}type>"
            else:
                predicate = self.node()
                if not predicate.startswith("<"):
                    raise ValueError(f"no predicate: {predicate}")
            while True:
                self.say(subject, predicate, self.object())
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.peek()[1] in (".", "]", "}") and self.peek()[0] == "mark":
                return

    def node(self) -> str:
        kind, told = self.peek()
        if kind == "iri":
            return f"<{self.address()}>"
        self.at += 1
        if kind == "name":
            start, _, rest = told.partition(":")
            if start not in self.prefixes:
                raise ValueError(f"prefix not declared: {start!r}")
            local = re.sub(r"\\(.)", r"\1", rest)
            return f"<{self.prefixes[start]}{local}>"
        if kind == "blank":
            return f"_:u{told[2:]}"
        if told == "[":
            me = self.fresh()
            if not self.take("]"):
                self.properties(me)
                self.need("]")
            return me
        if told == "(":
            return self.collection()
        raise ValueError(f"expected a node, found {told!r}")

    def collection(self) -> str:
        head, last = f"<{RDF}nil>", None
        while not self.take(")"):
            link = self.fresh()
            if last is None:
                head = link
            else:
                self.say(last, f"<{RDF}rest>", link)
            self.say(link, f"<{RDF}first>", self.object())
            last = link
        if last is not None:
            self.say(last, f"<{RDF}rest>", f"<{RDF}nil>")
        return head

    def object(self) -> str:
        kind, told = self.peek()
        if kind in ("short", "long"):
            self.at += 1
            shown = quoted(plain(told[3:-3] if kind == "long" else told[1:-1]))
            if self.peek()[0] == "at":
                return shown + self.next()[1].lower()
            if self.take("^^"):
                of = self.node()
                return shown if of == f"<{XSD}string>" else f"{shown}^^{of}"
            return shown
        if kind == "number":
            self.at += 1
            of = "double" if "e" in told.lower() else "decimal" if "." in told else "integer"
            return f'"{told}"^^<{XSD}{of}>'
        if kind == "word" and told in ("true", "false"):
            self.at += 1
            return f'"{told}"^^<{XSD}boolean>'
        return self.node()


def lines_of(text: str, base: str | None = None, graphs: bool = False) -> list[str]:
    """The statement lines of a Turtle document, or of a TriG one with ``graphs``; each once."""
    return Reader(text, base, graphs).read()
