"""Reading RDF/XML, one document at a time, as statement lines."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XML = "http://www.w3.org/XML/1998/namespace"
#: Attributes of the syntax itself, which are no properties.
SYNTAX = {f"{{{RDF}}}{n}" for n in ("about", "ID", "nodeID", "resource", "datatype", "parseType")} | {f"{{{XML}}}{n}" for n in ("lang", "base", "space")}


def _address(name: str) -> str:
    """The address that an expanded name stands for."""
    return name[1:].replace("}", "") if name.startswith("{") else name


def _quoted(text: str) -> str:
    for plain, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = text.replace(plain, mark)
    return f'"{text}"'


class Reader:
    """The statements of one document; ``base`` is what relative addresses are taken on."""

    def __init__(self, base: str = "") -> None:
        self.base, self.made, self.out = base, 0, []

    def blank(self) -> str:
        self.made += 1
        return f"_:g{self.made}"

    def say(self, s: str, p: str, o: str) -> None:
        self.out.append(f"{s} <{p}> {o} .")

    def literal(self, text: str, language: str | None, kind: str | None = None) -> str:
        return _quoted(text) + (f"^^<{kind}>" if kind else f"@{language.lower()}" if language else "")

    def scope(self, e: ElementTree.Element, base: str, language: str | None) -> tuple[str, str | None]:
        return urljoin(base, e.get(f"{{{XML}}}base", "")) if e.get(f"{{{XML}}}base") else base, e.get(f"{{{XML}}}lang", language) or None

    def name(self, e: ElementTree.Element, base: str) -> str:
        """What a node element is about."""
        if (about := e.get(f"{{{RDF}}}about")) is not None:
            return f"<{urljoin(base, about)}>"
        if (own := e.get(f"{{{RDF}}}ID")) is not None:
            return f"<{urljoin(base, '#' + own)}>"
        return f"_:n{own}" if (own := e.get(f"{{{RDF}}}nodeID")) is not None else self.blank()

    def properties(self, e: ElementTree.Element, me: str, base: str, language: str | None) -> None:
        """Statements from attributes that are properties."""
        for k, v in e.attrib.items():
            if k not in SYNTAX:
                self.say(me, _address(k), f"<{urljoin(base, v)}>" if k == f"{{{RDF}}}type" else self.literal(v, language))

    def node(self, e: ElementTree.Element, base: str, language: str | None) -> str:
        base, language = self.scope(e, base, language)
        me = self.name(e, base)
        if e.tag != f"{{{RDF}}}Description":
            self.say(me, RDF + "type", f"<{_address(e.tag)}>")
        self.properties(e, me, base, language)
        self.inside(e, me, base, language)
        return me

    def inside(self, e: ElementTree.Element, me: str, base: str, language: str | None) -> None:
        count = 0
        for child in e:
            count += child.tag == f"{{{RDF}}}li"
            p = f"{RDF}_{count}" if child.tag == f"{{{RDF}}}li" else _address(child.tag)
            o = self.value(child, *self.scope(child, base, language))
            self.say(me, p, o)
            if (own := child.get(f"{{{RDF}}}ID")) is not None:  # the statement itself has a name
                told = f"<{urljoin(base, '#' + own)}>"
                for part, x in (("type", f"<{RDF}Statement>"), ("subject", me), ("predicate", f"<{p}>"), ("object", o)):
                    self.say(told, RDF + part, x)

    def value(self, e: ElementTree.Element, base: str, language: str | None) -> str:
        kind = e.get(f"{{{RDF}}}parseType")
        if kind == "Resource":
            me = self.blank()
            self.inside(e, me, base, language)
            return me
        if kind == "Collection":
            head = f"<{RDF}nil>"
            for x in reversed([self.node(child, base, language) for child in e]):
                link = self.blank()
                self.say(link, RDF + "first", x)
                self.say(link, RDF + "rest", head)
                head = link
            return head
        if kind is not None:
            text = (e.text or "") + "".join(ElementTree.tostring(child, encoding="unicode") for child in e)
            return self.literal(text, None, RDF + "XMLLiteral")
        if len(e):
            return self.node(e[0], base, language)
        to, own = e.get(f"{{{RDF}}}resource"), e.get(f"{{{RDF}}}nodeID")
        if to is None and own is None and not any(k not in SYNTAX for k in e.attrib):
            return self.literal(e.text or "", language, e.get(f"{{{RDF}}}datatype"))
        me = f"<{urljoin(base, to)}>" if to is not None else f"_:n{own}" if own is not None else self.blank()
        self.properties(e, me, base, language)
        return me


def lines_of(text: str, base: str | None = None) -> Iterator[str]:
    """The statement lines of a document. Raises where it is no XML."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise ValueError(str(e)) from e
    told = Reader()
    start, language = told.scope(root, base or "", None)
    for e in root if root.tag == f"{{{RDF}}}RDF" else [root]:
        told.node(e, start, language)
    yield from dict.fromkeys(told.out)
