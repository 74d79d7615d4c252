"""Addresses, encodings, authorities and versions, as column expressions.

Base 58 needs arithmetic that SQL lacks; it is an Arrow function.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: The alphabets of base 58 and of lower-case base 32, and the largest safe version width.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"
VERSION = r"^[0-9]{1,38}$"
AUTHORITY = "key:ed25519:z"


def parse_uri(uri: Column, scheme: str) -> Column:
    """``scheme://authority/type/identifier`` as a struct; null where the address is malformed.

    The identifier may hold slashes; no part may be empty.
    """
    pattern = rf"^{scheme}://([^/]+)/([^/]+)/(.+)$"
    parts = F.struct(*[F.regexp_extract(uri, pattern, k + 1).alias(n) for k, n in enumerate(("authority", "type", "identifier"))])
    return F.when(uri.rlike(pattern), parts)


def build_uri(scheme: str, authority: Column, kind: Column, identifier: Column) -> Column:
    return F.concat(F.lit(f"{scheme}://"), authority, F.lit("/"), kind, F.lit("/"), identifier)


def authority_of(uri: Column, scheme: str) -> Column:
    """What stands before the first slash once the scheme is gone."""
    return F.substring_index(F.replace(uri, F.lit(f"{scheme}://"), F.lit("")), "/", 1)


def key_fragment(method: Column) -> Column:
    """The text after the last ``#``; all of it where there is none."""
    return F.substring_index(method, "#", -1)


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def to_base64url(data: Column) -> Column:
    """Base 64 with the address-safe letters and no padding."""
    return F.translate(F.rtrim(F.replace(F.base64(data), F.lit("\r\n"), F.lit("")), F.lit("=")), "+/", "-_")


def from_base64url(text: Column) -> Column:
    plain = F.translate(text, "-_", "+/")
    return F.unbase64(F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)))))


def _digits(data: bytes, alphabet: str) -> str:
    zeros = len(data) - len(data.lstrip(b"\0"))
    number, out = int.from_bytes(data, "big"), []
    while number:
        number, digit = divmod(number, len(alphabet))
        out.append(alphabet[digit])
    return alphabet[0] * zeros + "".join(reversed(out))


@F.arrow_udf(StringType())
def to_base58(data: pa.Array) -> pa.Array:
    """Bytes as base 58; each leading zero byte is one leading ``1``. Null stays null."""
    return pa.array([None if x is None else _digits(x, BASE58) for x in data.to_pylist()], pa.string())


@F.arrow_udf(BinaryType())
def from_base58(text: pa.Array) -> pa.Array:
    """Base 58 as bytes; null where a character is outside the alphabet."""

    def one(x: str | None) -> bytes | None:
        if x is None or any(c not in BASE58 for c in x):
            return None
        number = 0
        for c in x:
            number = number * 58 + BASE58.index(c)
        return b"\0" * (len(x) - len(x.lstrip("1"))) + number.to_bytes((number.bit_length() + 7) // 8, "big")

    return pa.array([one(x) for x in text.to_pylist()], pa.binary())


def to_base32(data: Column) -> Column:
    """Bytes as lower-case base 32 without padding, five bytes at a time: 40 bits are eight letters."""
    count = F.ceil(F.octet_length(data) * 8 / 5).cast("int")
    fives = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length(data) - 1) / 5).cast("int")), lambda k: F.rpad(F.hex(F.substring(data, k * 5 + 1, F.lit(5))), 10, "0"))
    digits = F.array_join(F.transform(fives, lambda h: F.lpad(F.conv(h, 16, 32), 8, "0")), "")
    letters = F.substring(F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32), F.lit(1), count)
    return F.when(F.octet_length(data) > 0, letters).when(data.isNotNull(), F.lit(""))


def multibase(text: Column) -> Column:
    """Base 58 with or without its leading ``z``, as bytes."""
    return from_base58(F.when(F.startswith(text, F.lit("z")), F.substring(text, 2, 2**31 - 1)).otherwise(text))


def derive_authority(public_key: Column) -> Column:
    """The authority of a 32-byte signing key; null for any other length."""
    return F.when(F.octet_length(public_key) == 32, F.concat(F.lit(AUTHORITY), to_base58(public_key)))


def public_key_of(authority: Column) -> Column:
    """The key bytes that an authority names; null where it names none."""
    found = F.regexp_extract(authority, rf"^{AUTHORITY}(.+)$", 1)
    return F.when(found != "", from_base58(found))


def version_number(version: Column) -> Column:
    """A version text as a number of at least 1; null where it is no such text."""
    number = F.when(version.rlike(VERSION), version).try_cast("decimal(38,0)")
    return F.when(number >= 1, number)


def check_version(version: Column) -> Column:
    """``struct<valid, reason>``: why a version text is not usable."""
    reason = (
        F.when(version.isNull(), "missing")
        .when(version == "", "empty")
        .when(~version.rlike(r"^-?[0-9]+$"), "not an integer")
        .when(~version.rlike(VERSION), F.when(F.startswith(version, F.lit("-")), "below 1").otherwise("too long"))
        .when(version_number(version).isNull(), "below 1")
    )
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"))


def increases(current: Column, previous: Column) -> Column:
    """Whether a version text is above the one before it; null where either is unusable."""
    return version_number(current) > version_number(previous)


def shorten(uri: Column, prefixes: dict[str, str]) -> Column:
    """The address with its prefix as a name, for the first prefix that fits."""
    out = F.lit(None).cast("string")
    for name, start in reversed(list(prefixes.items())):
        out = F.when(F.startswith(uri, F.lit(start)), F.concat(F.lit(f"{name}:"), F.substring(uri, len(start) + 1, 2**31 - 1))).otherwise(out)
    return F.coalesce(out, uri)
