"""Signatures, key agreement and sealed bytes, as column expressions.

Sealing runs on Spark's own AES. Ed25519 (RFC 8032), X25519 (RFC 7748) and keyed derivation have no
built-in expression; they are Arrow functions. Those with a curve in them work on whole batches (see
``curve``), and row by row on the few lines below where a batch has only some rows. Rows with a null
argument cost nothing, so callers pass null for rows that a cheaper test has already turned down.
"""

from __future__ import annotations

import hashlib
import hmac as _hmac
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

from attestry.functions import curve
from attestry.functions.curve import FIELD, ROOT, D

#: Fixed value of the curve: the order of the base point.
ORDER = 2**252 + 27742317777372353535851937790883648493

#: From so many rows on, a batch is worked on as a whole.
WHOLE = 48
#: Rows that are Python objects at once.
STRETCH = 1024

Point = tuple[int, int, int, int]  # extended coordinates: x = X/Z, y = Y/Z, T = XY/Z


def _sum(a: Point, b: Point) -> Point:
    low, high = (a[1] - a[0]) * (b[1] - b[0]) % FIELD, (a[1] + a[0]) * (b[1] + b[0]) % FIELD
    c, d = 2 * a[3] * b[3] * D % FIELD, 2 * a[2] * b[2] % FIELD
    e, f, g, h = high - low, d - c, d + c, high + low
    return e * f % FIELD, g * h % FIELD, f * g % FIELD, e * h % FIELD


def _point(y: int, odd: int) -> Point | None:
    """The curve point with this y whose x is odd or even; None where there is none."""
    if y >= FIELD:
        return None
    u, v = (y * y - 1) % FIELD, (D * y * y + 1) % FIELD
    x = u * pow(v, 3, FIELD) * pow(u * pow(v, 7, FIELD), (FIELD - 5) // 8, FIELD) % FIELD
    if v * x * x % FIELD != u:
        x = x * ROOT % FIELD
        if v * x * x % FIELD != u:
            return None
    if x == 0 and odd:
        return None
    x = FIELD - x if x & 1 != odd else x
    return x, y, 1, x * y % FIELD


ZERO: Point = (0, 1, 1, 0)
BASE: Point = _point(4 * pow(5, -1, FIELD) % FIELD, 0)  # type: ignore[assignment]


def _decode(data: bytes) -> Point | None:
    n = int.from_bytes(data, "little")
    return _point(n & ((1 << 255) - 1), n >> 255) if len(data) == 32 else None


def _encode(p: Point) -> bytes:
    z = pow(p[2], -1, FIELD)
    x, y = p[0] * z % FIELD, p[1] * z % FIELD
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _times(a: int, p: Point, b: int = 0, q: Point = ZERO) -> Point:
    """a * p + b * q, both scalars bit by bit together."""
    both, out = _sum(p, q), ZERO
    for k in range(max(a.bit_length(), b.bit_length()) - 1, -1, -1):
        out = _sum(out, out)
        bits = (a >> k & 1, b >> k & 1)
        if bits != (0, 0):
            out = _sum(out, both if bits == (1, 1) else p if bits[0] else q)
    return out


def _clamped(half: bytes) -> int:
    n = int.from_bytes(half, "little")
    return n & ~7 & ((1 << 254) - 1) | 1 << 254


def _challenge(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


def ed25519_public(seed: bytes) -> bytes:
    return _encode(_times(_clamped(hashlib.sha512(seed).digest()[:32]), BASE))


def ed25519_sign(message: bytes, seed: bytes) -> bytes:
    held = hashlib.sha512(seed).digest()
    a = _clamped(held[:32])
    public = _encode(_times(a, BASE))
    r = _challenge(held[32:], message)
    first = _encode(_times(r, BASE))
    return first + ((r + _challenge(first, public, message) * a) % ORDER).to_bytes(32, "little")


def ed25519_verify(message: bytes, signature: bytes, public: bytes) -> bool:
    if len(signature) != 64:
        return False
    key, first, s = _decode(public), _decode(signature[:32]), int.from_bytes(signature[32:], "little")
    if key is None or first is None or s >= ORDER:
        return False
    h = _challenge(signature[:32], public, message)
    got = _times(s, BASE, h, (FIELD - key[0], key[1], 1, FIELD - key[3]))
    return (got[0] * first[2] - first[0] * got[2]) % FIELD == 0 and (got[1] * first[2] - first[1] * got[2]) % FIELD == 0


def x25519_shared(secret: bytes, public: bytes) -> bytes:
    """The Montgomery ladder over the public u-coordinate."""
    k, u = _clamped(secret), int.from_bytes(public, "little") & ((1 << 255) - 1)
    x2, z2, x3, z3 = 1, 0, u, 1
    for bit in range(254, -1, -1):
        if k >> bit & 1:
            x2, z2, x3, z3 = x3, z3, x2, z2
        a, b, c, d = x2 + z2, x2 - z2, x3 + z3, x3 - z3
        da, cb, aa, bb = d * a % FIELD, c * b % FIELD, a * a % FIELD, b * b % FIELD
        x3, z3 = (da + cb) ** 2 % FIELD, u * (da - cb) ** 2 % FIELD
        x2, z2 = aa * bb % FIELD, (aa - bb) * (aa + 121665 * (aa - bb)) % FIELD
        if k >> bit & 1:
            x2, z2, x3, z3 = x3, z3, x2, z2
    return (x2 * pow(z2, FIELD - 2, FIELD) % FIELD).to_bytes(32, "little")


def montgomery_public(edwards: bytes) -> bytes:
    """The key-agreement key that belongs to a signing key."""
    y = int.from_bytes(edwards, "little") & ((1 << 255) - 1)
    return ((1 + y) * pow(1 - y, FIELD - 2, FIELD) % FIELD).to_bytes(32, "little")


def montgomery_secret(seed: bytes) -> bytes:
    return _clamped(hashlib.sha512(seed).digest()[:32]).to_bytes(32, "little")


def hkdf_sha256(secret: bytes, salt: bytes, info: bytes, length: int = 32) -> bytes:
    key, out, block = _hmac.digest(salt or b"\0" * 32, secret, "sha256"), b"", b""
    while len(out) < length:
        block = _hmac.digest(key, block + info + bytes([len(out) // 32 + 1]), "sha256")
        out += block
    return out[:length]


def _rows(kind: pa.DataType, work: Callable, *columns: pa.Array) -> pa.Array:
    lists = [c.to_pylist() for c in columns]
    return pa.array([None if any(x is None for x in row) else work(*row) for row in zip(*lists)], kind)


def _bytes(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 32)


def _little(x: int) -> bytes:
    return x.to_bytes(32, "little")


def _batch(kind: pa.DataType, one: Callable, many: Callable, fits: Callable, *columns: pa.Array) -> pa.Array:
    """Rows without nulls through ``many``, which takes and gives lists; few rows, and those that do not fit it, through ``one``.

    A batch of Spark's holds up to 10,000 rows, whatever their texts' length; no more than ``STRETCH`` of them are Python objects at once.
    """
    n = len(columns[0])
    return pa.concat_arrays([_stretch(kind, one, many, fits, *[c.slice(k, STRETCH) for c in columns]) for k in range(0, n, STRETCH)] or [pa.array([], kind)])


def _stretch(kind: pa.DataType, one: Callable, many: Callable, fits: Callable, *columns: pa.Array) -> pa.Array:
    lists = [c.to_pylist() for c in columns]
    rows = [row if all(x is not None for x in row) else None for row in zip(*lists)]
    whole = [k for k, row in enumerate(rows) if row is not None and fits(*row)]
    out = [None] * len(rows)
    if len(whole) < WHOLE:
        whole = []
    else:
        for k, told in zip(whole, many(*zip(*(rows[k] for k in whole)))):
            out[k] = told
    done = set(whole)
    for k, row in enumerate(rows):
        if row is not None and k not in done:
            out[k] = one(*row)
    return pa.array(out, kind)


def ed25519_publics(seeds: list[bytes]) -> list[bytes]:
    found: dict[bytes, bytes] = {}
    held = list(dict.fromkeys(seeds))
    scalars = _bytes([_little(_clamped(hashlib.sha512(s).digest()[:32])) for s in held])
    found.update(zip(held, (bytes(x) for x in curve.base_multiples(scalars))))
    return [found[s] for s in seeds]


def ed25519_signatures(messages: list[bytes], seeds: list[bytes]) -> list[bytes]:
    publics = ed25519_publics(seeds)
    held = [hashlib.sha512(s).digest() for s in seeds]
    once = [_challenge(h[32:], m) for h, m in zip(held, messages)]
    firsts = [bytes(x) for x in curve.base_multiples(_bytes([_little(r) for r in once]))]
    told = ((r + _challenge(f, p, m) * _clamped(h[:32])) % ORDER for r, f, p, m, h in zip(once, firsts, publics, messages, held))
    return [f + _little(s) for f, s in zip(firsts, told)]


def ed25519_verdicts(messages: list[bytes], signatures: list[bytes], publics: list[bytes]) -> list[bool]:
    """A signature's first half is a point's only form or none, so it is compared as bytes."""
    keys = {k: i for i, k in enumerate(dict.fromkeys(publics))}
    low = np.array([int.from_bytes(s[32:], "little") < ORDER for s in signatures])
    scalars = _bytes([_little(_challenge(s[:32], p, m)) for m, s, p in zip(messages, signatures, publics)])
    base = _bytes([s[32:] if fine else bytes(32) for s, fine in zip(signatures, low)])
    got, points = curve.combined(_bytes(list(keys)), np.array([keys[p] for p in publics]), scalars, base)
    return (low & points & (got == _bytes([s[:32] for s in signatures])).all(1)).tolist()


def x25519_secrets(secrets: list[bytes], publics: list[bytes]) -> list[bytes]:
    return [bytes(x) for x in curve.ladder(_bytes([_little(_clamped(s)) for s in secrets]), _bytes(list(publics)))]


def montgomery_publics(keys: list[bytes]) -> list[bytes]:
    return [bytes(x) for x in curve.to_montgomery(_bytes(list(keys)))]


@F.arrow_udf(BooleanType())
def _verify(message: pa.Array, signature: pa.Array, public: pa.Array) -> pa.Array:
    return _batch(pa.bool_(), ed25519_verify, ed25519_verdicts, lambda m, s, p: len(s) == 64 and len(p) == 32, message, signature, public)


@F.arrow_udf(BinaryType())
def _sign(message: pa.Array, seed: pa.Array) -> pa.Array:
    return _batch(pa.binary(), ed25519_sign, ed25519_signatures, lambda m, s: True, message, seed)


@F.arrow_udf(BinaryType())
def _public(seed: pa.Array) -> pa.Array:
    return _batch(pa.binary(), ed25519_public, ed25519_publics, lambda s: True, seed)


@F.arrow_udf(BinaryType())
def _agreement_key(secret: pa.Array, public: pa.Array, salt: pa.Array, info: pa.Array) -> pa.Array:
    def many(secrets: list[bytes], publics: list[bytes], salts: list[bytes], infos: list[bytes]) -> list[bytes]:
        return [hkdf_sha256(*row) for row in zip(x25519_secrets(secrets, publics), salts, infos)]

    return _batch(pa.binary(), lambda s, p, n, i: hkdf_sha256(x25519_shared(s, p), n, i), many, lambda s, p, n, i: len(s) == len(p) == 32, secret, public, salt, info)


@F.arrow_udf(BinaryType())
def shared_secret(secret: pa.Array, public: pa.Array) -> pa.Array:
    """The X25519 function of a secret and a public half; of the base point 9, the secret's own public half."""
    return _batch(pa.binary(), x25519_shared, x25519_secrets, lambda s, p: len(s) == len(p) == 32, secret, public)


@F.arrow_udf(BinaryType())
def _hmac_rows(key: pa.Array, data: pa.Array) -> pa.Array:
    return _rows(pa.binary(), lambda k, d: _hmac.digest(k, d, "sha256"), key, data)


@F.arrow_udf(BinaryType())
def to_agreement_public(signing: pa.Array) -> pa.Array:
    return _batch(pa.binary(), montgomery_public, montgomery_publics, lambda k: len(k) == 32, signing)


@F.arrow_udf(BinaryType())
def to_agreement_secret(seed: pa.Array) -> pa.Array:
    return _rows(pa.binary(), montgomery_secret, seed)


def verify_signature(message: Column, signature: Column, public_key: Column) -> Column:
    """Whether an Ed25519 signature holds; malformed keys and signatures do not, null gives false."""
    return F.coalesce(_verify(message.cast("binary"), signature, public_key), F.lit(False))


def sign(message: Column, seed: Column) -> Column:
    return _sign(message.cast("binary"), seed)


def public_key(seed: Column) -> Column:
    return _public(seed)


def hmac_of(key: Column, data: Column) -> Column:
    """HMAC-SHA-256 under a key that each row brings."""
    return _hmac_rows(key, data.cast("binary"))


def seal(key: Column, nonce: Column, data: Column) -> Column:
    """AES-256-GCM: ciphertext and tag, without the nonce that Spark puts in front."""
    whole = F.aes_encrypt(data.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), nonce)
    return F.substring(whole, 13, 2**31 - 1)


def unseal(key: Column, nonce: Column, sealed: Column) -> Column:
    """The plaintext; null where key, nonce or tag do not fit."""
    fits = (F.octet_length(key) == 32) & (F.octet_length(nonce) == 12)
    return F.try_aes_decrypt(F.when(fits, F.concat(nonce, sealed)), F.when(fits, key), F.lit("GCM"))


def wrapping_key(secret: Column, public: Column, nonce: Column, label: str, recipient: Column) -> Column:
    """The key under which a secret travels to a recipient, from either side's secret half."""
    return _agreement_key(secret, public, nonce, F.concat(F.lit(label), recipient).cast("binary"))


def wrap(content_key: Column, secret: Column, public: Column, nonce: Column, label: str, recipient: Column) -> Column:
    return seal(wrapping_key(secret, public, nonce, label, recipient), nonce, content_key)


def unwrap(wrapped: Column, secret: Column, public: Column, nonce: Column, label: str, recipient: Column) -> Column:
    """The wrapped key; null for a wrong secret or recipient."""
    return unseal(wrapping_key(secret, public, nonce, label, recipient), nonce, wrapped)
