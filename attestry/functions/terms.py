"""RDF terms as structs, and the functions of graph queries on them.

A term is ``struct<kind, value, datatype, language>`` with kind ``uri``, ``bnode`` or ``literal``; a plain
string literal has no datatype. Null is an unbound variable; an expression that fails is null too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
TERM = "struct<kind:string,value:string,datatype:string,language:string>"
#: The numeric datatypes, in the order of promotion, and what belongs to the first.
NUMERIC = ("integer", "decimal", "float", "double")
INTEGERS = ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")


def term(kind: Column | str, value: Column, datatype: Column | None = None, language: Column | None = None) -> Column:
    """A term; a datatype of xsd:string is left out, and a null value makes the term null."""
    none = F.lit(None).cast("string")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    kept = none if datatype is None else F.nullif(datatype, F.lit(XSD + "string"))
    built = F.struct(kind.alias("kind"), value.cast("string").alias("value"), kept.alias("datatype"), (none if language is None else language).alias("language"))
    return F.when(value.isNotNull(), built)


def uri(value: Column | str) -> Column:
    return term("uri", F.lit(value) if isinstance(value, str) else value)


def literal(value: Column | str | int | float, datatype: str | None = None, language: str | None = None) -> Column:
    if not isinstance(value, Column):
        if datatype is None and not isinstance(value, str):
            datatype = XSD + ("integer" if isinstance(value, int) else "double")
        value = F.lit(value)
    return term("literal", value, F.lit(datatype) if datatype else None, F.lit(language) if language else None)


def iri(t: Column, base: str | None = None) -> Column:
    """IRI: the address that a string or an address names, taken on ``base`` where it has no scheme; else null."""
    named = text(t)
    full = named if base is None else F.when(named.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), named).otherwise(F.concat(F.lit(base), named))
    return F.when(is_uri(t) | _plain(t), uri(full))


def bnode(label: Column | None = None) -> Column:
    """BNODE: a blank node, the same for equal labels within a solution, or a new one for each row."""
    return term("bnode", F.regexp_replace(F.uuid(), "-", "") if label is None else F.when(_plain(label), F.sha2(label["value"], 256)))


def strdt(t: Column, kind: str) -> Column:
    """STRDT: a plain string as a literal of a datatype; null for other terms."""
    return term("literal", F.when(_plain(t), t["value"]), F.lit(kind))


def strlang(t: Column, tag: str) -> Column:
    """STRLANG: a plain string in a language; null for other terms."""
    return term("literal", F.when(_plain(t), t["value"]), None, F.lit(tag))


def _plain(t: Column) -> Column:
    return (t["kind"] == "literal") & t["language"].isNull() & t["datatype"].isNull()


def digest(name: str, t: Column) -> Column:
    """MD5, SHA1, SHA256, SHA384 and SHA512 of a plain string, as a literal in lower-case hexadecimal."""
    told = t["value"].cast("binary")
    found = F.md5(told) if name == "md5" else F.sha1(told) if name == "sha1" else F.sha2(told, int(name.removeprefix("sha")))
    return term("literal", F.when(_plain(t), found))


def coalesce(*ts: Column) -> Column:
    """COALESCE: the first term that is bound."""
    return F.coalesce(*ts)


def if_(test: Column, yes: Column, no: Column) -> Column:
    """IF: by a test's truth; null where the test fails."""
    return F.when(test, yes).when(~test, no)


def uuid() -> Column:
    """UUID: a new address for each row."""
    return uri(F.concat(F.lit("urn:uuid:"), F.uuid()))


def struuid() -> Column:
    """STRUUID: a new plain string for each row."""
    return term("literal", F.uuid())


def is_uri(t: Column) -> Column:
    return t["kind"] == "uri"


def is_blank(t: Column) -> Column:
    return t["kind"] == "bnode"


def is_literal(t: Column) -> Column:
    return t["kind"] == "literal"


def text(t: Column) -> Column:
    """STR: the lexical form of a literal or the address; null for a blank node."""
    return F.when(t["kind"] != "bnode", t["value"])


def lang(t: Column) -> Column:
    return F.when(is_literal(t), F.coalesce(t["language"], F.lit("")))


def lang_matches(tag: Column, wanted: str) -> Column:
    low = F.lower(tag)
    return (tag != "") if wanted == "*" else (low == wanted.lower()) | F.startswith(low, F.lit(wanted.lower() + "-"))


def datatype(t: Column) -> Column:
    """The datatype's address; of a plain literal xsd:string, of one with a language rdf:langString."""
    tagged = F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")
    return F.when(is_literal(t), F.when(t["language"].isNotNull(), tagged).otherwise(F.coalesce(t["datatype"], F.lit(XSD + "string"))))


def same_term(a: Column, b: Column) -> Column:
    return a == b


def rank(t: Column) -> Column:
    """Place of a numeric literal's type in the order of promotion, from 0; null for other terms."""
    short = F.regexp_extract(t["datatype"], f"^{XSD}(.+)$", 1)
    out = F.when(short.isin(*INTEGERS), 0)
    for k, name in enumerate(NUMERIC[1:], 1):
        out = out.when(short == name, k)
    return F.when(is_literal(t), out)


def number(t: Column) -> Column:
    """The value of a numeric literal as a double; null for others and malformed ones."""
    return F.when(rank(t).isNotNull(), t["value"].try_cast("double"))


def is_numeric(t: Column) -> Column:
    return number(t).isNotNull()


def arithmetic(op: str, a: Column, b: Column) -> Column:
    """``+ - * /`` of two numeric literals, of the promoted type; integers divide to a decimal."""
    x, y = number(a), number(b)
    value = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[op]
    place = F.greatest(rank(a), rank(b), F.lit(1 if op == "/" else 0))
    kind = F.element_at(F.array(*[F.lit(XSD + n) for n in NUMERIC]), place + 1)
    shown = F.when(place == 0, value.cast("long").cast("string")).otherwise(value.cast("string"))
    return term("literal", F.when(x.isNotNull() & y.isNotNull(), shown), kind)


def compare(op: str, a: Column, b: Column) -> Column:
    """``= != < > <= >=``: numbers by value, equal types by their text, other terms by identity only."""
    both = number(a).isNotNull() & number(b).isNotNull()
    alike = is_literal(a) & is_literal(b) & datatype(a).eqNullSafe(datatype(b)) & a["language"].eqNullSafe(b["language"])
    ops = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
    by = ops[op]
    out = F.when(both, by(number(a), number(b))).when(alike, by(a["value"], b["value"]))
    return out.when(F.lit(op in ("=", "!=")), by(F.to_json(a), F.to_json(b)))


def truth(t: Column) -> Column:
    """The effective boolean value of a literal; null for other terms."""
    kind = t["datatype"]
    return F.when(is_literal(t), F.when(kind == XSD + "boolean", t["value"].isin("true", "1")).when(is_numeric(t), (number(t) != 0) & ~F.isnan(number(t))).when(kind.isNull(), t["value"] != ""))


def sort_keys(t: Column) -> list[Column]:
    """Ascending order of terms: unbound, blank nodes, addresses, literals; numbers by value first."""
    place = F.when(t.isNull(), 0).when(is_blank(t), 1).when(is_uri(t), 2).otherwise(3)
    return [place, number(t), t["value"], t["datatype"], t["language"]]


def string_before(a: Column, b: str) -> Column:
    return F.when(F.contains(a, F.lit(b)), F.substring_index(a, b, 1) if b else F.lit("")).otherwise("")


def string_after(a: Column, b: str) -> Column:
    at = F.locate(b, a)
    return F.when(at > 0, F.substring(a, at + F.lit(len(b)), F.lit(2**31 - 1))).otherwise("")


def encode_for_uri(a: Column) -> Column:
    """Percent-encoding of all but letters, digits and ``-_.~``."""
    return F.replace(F.replace(F.replace(F.url_encode(a), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def round_half_up(x: Column) -> Column:
    """The nearest whole number; halves go up, also below zero."""
    return F.floor(x + 0.5)


def timezone_of(stamp: Column) -> Column:
    """The zone part of a timestamp's text, empty where there is none."""
    return F.regexp_extract(stamp, r"(Z|[+-][0-9]{2}:[0-9]{2})$", 1)
