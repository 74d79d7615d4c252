"""JSON documents: canonical text, pointers, patches and differences.

Reading a value by pointer is a built-in expression. The canonical text takes the Variant route where
that gives the same result; the rest, and patches, are Arrow functions whose work on a row is small.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def number_text(x: float) -> str:
    """A number as ECMAScript prints it: the shortest digits, an exponent from 1e21 and below 1e-6."""
    x = float(x)
    if not math.isfinite(x):
        raise ValueError("not a finite number")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    sign, digits, power = Decimal(repr(x)).normalize().as_tuple()
    digits = "".join(map(str, digits))
    point = len(digits) + power  # digits before the point
    lead = "-" if sign else ""
    if 0 < point <= 21:
        return f"{lead}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{lead}0.{'0' * -point}{digits}"
    return f"{lead}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def canonical(value: object) -> str:
    """Canonical JSON: keys in order of UTF-16 code units, no white space, ECMAScript numbers."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    return number_text(value)


def _over(kind: pa.DataType, work: Callable, *columns: pa.Array) -> pa.Array:
    def one(*row: str | None) -> object:
        if row[0] is None:
            return None
        try:
            return work(*row)
        except (ValueError, KeyError, TypeError, IndexError, RecursionError):
            return None

    return pa.array([one(*row) for row in zip(*(c.to_pylist() for c in columns))], kind)


@F.arrow_udf(StringType())
def _canonical(text: pa.Array) -> pa.Array:
    return _over(pa.string(), lambda x: canonical(json.loads(x)), text)


def canonical_json(text: Column) -> Column:
    """The canonical text of a JSON text; null where it is none."""
    return _canonical(text)


def canonical_plain(text: Column) -> Column:
    """Canonical text on the built-in Variant route.

    The same as ``canonical_json`` for texts without exponents, numbers of over 15 digits and control
    escapes; null for others, so that ``coalesce`` with it spends Python on those only.
    """
    hard = text.rlike(r"[0-9][eE][+-]?[0-9]|[0-9.]{16,}|\\u00[01]")
    return F.when(~hard, F.to_json(F.try_parse_json(text)))


def pointer_segments(pointer: Column) -> Column:
    """The unescaped segments of a JSON pointer; the empty pointer has none."""
    parts = F.transform(F.split(F.substring(pointer, 2, 2**31 - 1), "/"), lambda s: F.replace(F.replace(s, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    return F.when(pointer == "", F.array().cast("array<string>")).otherwise(parts)


def walk(root: object, segments: list[str]) -> tuple[object, str]:
    """The container and the key that a pointer's segments lead to; raises where one is missing."""
    for s in segments[:-1]:
        root = root[int(s)] if isinstance(root, list) else root[s]
    if not isinstance(root, (dict, list)):
        raise KeyError(segments[-1])
    return root, segments[-1]


def _segments(pointer: str) -> list[str]:
    if not pointer.startswith("/"):
        raise ValueError(pointer)
    return [s.replace("~1", "/").replace("~0", "~") for s in pointer[1:].split("/")]


def apply_ops(document: object, ops: list[dict], standard: bool) -> object:
    """Applies add, remove and replace in order, all or none.

    ``standard`` inserts into and removes from arrays as RFC 6902 does. Otherwise an array is treated
    like an object keyed by place: an add overwrites, a remove leaves null behind.
    """
    for op in ops:
        at, key = walk(document, _segments(op["path"]))
        listed = isinstance(at, list)
        place = (len(at) if standard and key == "-" else int(key)) if listed else key
        there = (0 <= place < len(at)) if listed else place in at
        if op["op"] not in ("add", "remove", "replace") or (op["op"] != "add" and not there):
            raise ValueError(op["op"])
        if op["op"] == "remove":
            if listed and not standard:
                at[place] = None
            else:
                del at[place]
        elif listed and op["op"] == "add" and standard:
            if place > len(at):
                raise IndexError(place)
            at.insert(place, op["value"])
        else:
            if listed:
                at.extend([None] * (place + 1 - len(at)))
            at[place] = op["value"]
    return document


def apply_patch(document: Column, ops: Column, standard: bool = False) -> Column:
    """The canonical text of a patched JSON document; null where the patch does not apply as a whole."""

    @F.arrow_udf(StringType())
    def of(text: pa.Array, patch: pa.Array) -> pa.Array:
        return _over(pa.string(), lambda t, p: canonical(apply_ops(json.loads(t), json.loads(p), standard)), text, patch)

    return of(document, ops)


def differences(a: object, b: object, at: str = "") -> list[dict]:
    """Ops from a to b: objects key by key, everything else as a whole; names are not escaped."""
    if not (isinstance(a, dict) and isinstance(b, dict)):
        return [] if a == b else [{"op": "replace", "path": at, "value": b}]
    out = [{"op": "remove", "path": f"{at}/{k}"} for k in a if k not in b]
    for k, v in b.items():
        out += differences(a[k], v, f"{at}/{k}") if k in a else [{"op": "add", "path": f"{at}/{k}", "value": v}]
    return out


@F.arrow_udf(StringType())
def diff_json(a: pa.Array, b: pa.Array) -> pa.Array:
    """The ops that turn one JSON text into another, as JSON."""
    return _over(pa.string(), lambda x, y: canonical(differences(json.loads(x), json.loads(y))), a, b)


def replace_values(value: object, search: str, by: str) -> object:
    """Replaces a text inside every string value; keys stay."""
    if isinstance(value, str):
        return value.replace(search, by)
    if isinstance(value, list):
        return [replace_values(v, search, by) for v in value]
    return {k: replace_values(v, search, by) for k, v in value.items()} if isinstance(value, dict) else value


def fill_placeholder(document: Column, placeholder: str, by: Column) -> Column:
    """Canonical text of a document with a placeholder replaced in its string values."""

    @F.arrow_udf(StringType())
    def of(text: pa.Array, value: pa.Array) -> pa.Array:
        return _over(pa.string(), lambda t, v: canonical(replace_values(json.loads(t), placeholder, v)), text, value)

    return of(document, by)
