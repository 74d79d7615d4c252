"""Column functions against fixed vectors, and Python as the other opinion."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.functions import crypto, curve, hashing, jsondoc, temporal, terms, text


def one(spark, column, **columns):
    """The value of a column expression over a row of literals."""
    row = spark.range(1).select(*[(v if not isinstance(v, (str, bytes, int, type(None))) else F.lit(v)).alias(k) for k, v in columns.items()]) if columns else spark.range(1)
    return row.select(column.alias("x")).first().x


# --- text ----------------------------------------------------------------------------------------


def test_uri(spark):
    rows = spark.createDataFrame([("vk://a/b/c/d",), ("vk://a/b/",), ("vk://a/b",), ("http://a/b/c",), ("",), (None,), ("vk:///b/c",)], "u string")
    got = [r.p for r in rows.select(text.parse_uri(F.col("u"), "vk").alias("p")).collect()]
    assert got[0].asDict() == {"authority": "a", "type": "b", "identifier": "c/d"} and got[1:] == [None] * 6
    assert one(spark, text.build_uri("vk", F.lit("a"), F.lit("b"), F.lit("c"))) == "vk://a/b/c"
    assert one(spark, text.authority_of(F.lit("vk://key:ed25519:zX/data/y"), "vk")) == "key:ed25519:zX"


@pytest.mark.parametrize("data, want", [(b"", ""), (b"\0", "1"), (b"\0\0\x01", "112"), (b"Hello World!", "2NEpo7TZRRrLZSi2U"), (bytes.fromhex("0000287fb4cd"), "11233QC4")])
def test_base58(spark, data, want):
    assert one(spark, text.to_base58(F.lit(data))) == want
    assert bytes(one(spark, text.from_base58(F.lit(want)))) == data


def test_base58_rejects_other_characters(spark):
    assert one(spark, text.from_base58(F.lit("0OIl"))) is None


@pytest.mark.parametrize("data", [b"", b"f", b"fo", b"foo", b"foob", b"fooba", b"foobar", bytes(range(256))])
def test_base32_and_base64url(spark, data):
    assert one(spark, text.to_base32(F.lit(data))) == base64.b32encode(data).decode().lower().rstrip("=")
    plain = base64.urlsafe_b64encode(data).decode().rstrip("=")
    assert one(spark, text.to_base64url(F.lit(data))) == plain
    assert bytes(one(spark, text.from_base64url(F.lit(plain)))) == data


def test_versions(spark):
    rows = spark.createDataFrame([(v,) for v in ("1", "9007199254740993", "0", "-1", "1.5", "", None, "abc", "9" * 39)], "v string")
    got = rows.select(text.check_version(F.col("v")).alias("c"), text.version_number(F.col("v")).cast("string").alias("n")).collect()
    assert [r.n for r in got] == ["1", "9007199254740993", *[None] * 7]
    assert [r.c.reason for r in got] == [None, None, "below 1", "below 1", "not an integer", "empty", "missing", "not an integer", "too long"]
    assert one(spark, text.increases(F.lit("10"), F.lit("9"))) is True


# --- time ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("stamp, days, want", [("2024-02-28T00:00:00Z", "P1D", "2024-02-29T00:00:00Z"), ("2023-02-28T23:59:59Z", "P1D", "2023-03-01T23:59:59Z"), ("2024-12-31T01:02:03.450Z", "P366D", "2026-01-01T01:02:03.450Z"), ("2025-07-01T00:00:00Z", "P183D", "2025-12-31T00:00:00Z"), ("2025-01-01T00:00:00", "P1D", None)])
def test_add_duration(spark, stamp, days, want):
    assert one(spark, temporal.add_duration(F.lit(stamp), F.lit(days))) == want


@pytest.mark.parametrize("duration, want", [("P1D", 86_400_000), ("PT1.5S", 1500), ("P1Y2M3DT4H5M6S", 365 * 86_400_000 + 60 * 86_400_000 + 3 * 86_400_000 + 4 * 3_600_000 + 5 * 60_000 + 6000), ("P", None), ("P1W", None), ("PT", None)])
def test_duration_millis(spark, duration, want):
    assert one(spark, temporal.duration_millis(F.lit(duration))) == want


def test_staleness_bounds(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, temporal.custody_stale(at("2025-01-01"), F.lit("P30D"), at("2025-01-31"))) is False
    assert one(spark, temporal.custody_stale(at("2025-01-01"), F.lit("P30D"), at("2025-01-31 00:00:01"))) is True
    assert one(spark, temporal.document_stale(at("2025-01-01"), F.lit(0), at("2099-01-01"))) is False
    assert one(spark, temporal.compare_stamps(F.lit("2025-01-01T00:00:00.5Z"), F.lit("2025-01-01T00:00:00.250Z"))) == 1


# --- digests -------------------------------------------------------------------------------------


def test_hmac_and_roots(spark):
    for key in (b"k", b"x" * 64, b"long" * 40):
        want = hmac.new(key, b"data", "sha256")
        assert one(spark, hashing.hmac_sha256(key, F.lit("data"))) == want.hexdigest()
        assert bytes(one(spark, crypto.hmac_of(F.lit(key), F.lit("data")))) == want.digest()
    rows = spark.createDataFrame([(k, hashlib.sha256(bytes([k])).digest()) for k in range(40)], "i int, h binary").repartition(5)
    got = rows.agg(hashing.ordered_root(F.col("i"), F.col("h")).alias("r")).first().r
    assert got == hashlib.sha256(b"".join(hashlib.sha256(bytes([k])).digest() for k in range(40))).hexdigest()


@pytest.mark.parametrize("size", [0, 23, 24, 255, 256, 70_000])
def test_content_identifier(spark, size):
    data = b"x" * size

    def head(major, n):
        return bytes([major + n]) if n < 24 else bytes([major + 24, n]) if n < 256 else bytes([major + 25]) + n.to_bytes(2, "big") if n < 65536 else bytes([major + 26]) + n.to_bytes(4, "big")

    def string(s):
        return head(0x60, len(s)) + s.encode()

    body = b"\xa3" + string("@type") + string("Content") + string("vk:content") + head(0x40, size) + data + string("vk:canonicalization") + string("JCS")
    want = "b" + base64.b32encode(bytes.fromhex("01711220") + hashlib.sha256(body).digest()).decode().lower().rstrip("=")
    assert one(spark, hashing.cid(F.lit(data), "Content", "JCS", "vk")) == want
    assert one(spark, hashing.verify(F.lit(want), F.lit(data))) is True
    assert one(spark, hashing.verify(F.lit("md5:1"), F.lit(data))) is None


# --- JSON ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("given, want", [('{"b":1,"a":{"d":[1.0,0.10,-0.0],"c":null}}', '{"a":{"c":null,"d":[1,0.1,0]},"b":1}'), ("[1e21,1e-7,1.5E3,333333333.33333329,4.5,2e-3,0.000001]", "[1e+21,1e-7,1500,333333333.3333333,4.5,0.002,0.000001]"), ('{"\\u20ac":"\\u001f","\\r":"\\/","😀":1,"～":2}', '{"\\r":"/","€":"\\u001f","😀":1,"～":2}'), ("{", None), (None, None)])
def test_canonical_json(spark, given, want):
    assert one(spark, jsondoc.canonical_json(F.lit(given).cast("string"))) == want


PATCHES = [
    ({"a": 1}, [{"op": "add", "path": "/b", "value": [1]}], {"a": 1, "b": [1]}, {"a": 1, "b": [1]}),
    ({"a": {"x/y": 1, "m~n": 2}}, [{"op": "remove", "path": "/a/x~1y"}, {"op": "replace", "path": "/a/m~0n", "value": 3}], {"a": {"m~n": 3}}, {"a": {"m~n": 3}}),
    ({"l": [1, 2, 3]}, [{"op": "add", "path": "/l/1", "value": 9}], {"l": [1, 9, 3]}, {"l": [1, 9, 2, 3]}),
    ({"l": [1, 2, 3]}, [{"op": "remove", "path": "/l/0"}], {"l": [None, 2, 3]}, {"l": [2, 3]}),
    ({"a": 1}, [{"op": "remove", "path": "/z"}], None, None),
    ({"a": 1}, [{"op": "replace", "path": "/b/c", "value": 1}], None, None),
    ({"a": 1}, [{"op": "move", "path": "/a"}], None, None),
]


@pytest.mark.parametrize("doc, ops, plain, standard", PATCHES)
def test_patches(spark, doc, ops, plain, standard):
    for flag, want in ((False, plain), (True, standard)):
        got = one(spark, jsondoc.apply_patch(F.lit(json.dumps(doc)), F.lit(json.dumps(ops)), flag))
        assert (json.loads(got) if got else None) == want


def test_differences_lead_from_one_to_the_other(spark):
    a, b = {"x": 1, "y": {"p": [1, 2], "q": 3}, "gone": None}, {"x": 2, "y": {"p": [1], "q": 3, "r": {}}, "new": True}
    ops = one(spark, jsondoc.diff_json(F.lit(json.dumps(a)), F.lit(json.dumps(b))))
    assert json.loads(one(spark, jsondoc.apply_patch(F.lit(json.dumps(a)), F.lit(ops)))) == b


def test_placeholder_spares_keys(spark):
    got = one(spark, jsondoc.fill_placeholder(F.lit('{"ME":"by ME","l":["ME",1]}'), "ME", F.lit("you")))
    assert json.loads(got) == {"ME": "by you", "l": ["you", 1]}


# --- curves and sealing --------------------------------------------------------------------------

#: Public vectors of RFC 8032, section 7.1: seed, public key, message, signature.
SIGNED = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
]


@pytest.mark.parametrize("seed, public, message, signature", SIGNED)
def test_signatures(spark, seed, public, message, signature):
    s, p, m, g = (bytes.fromhex(x) for x in (seed, public, message, signature))
    assert crypto.ed25519_public(s) == p and crypto.ed25519_sign(m, s) == g
    ok = lambda m_, g_, p_: one(spark, crypto.verify_signature(F.lit(m_), F.lit(g_), F.lit(p_)))
    assert ok(m, g, p) and not ok(m + b"!", g, p) and not ok(m, g[:-1], p) and not ok(m, bytes([g[0] ^ 1]) + g[1:], p) and not ok(m, g, b"\xff" * 32)
    assert not crypto.ed25519_verify(m, g[:32] + (int.from_bytes(g[32:], "little") + crypto.ORDER).to_bytes(32, "little"), p)


def test_agreement():
    a, b = (bytes.fromhex(x) for x in ("77076d0a7318a57d3c16c17251b26645f4c4e6f3a2f6a6b0f3d1f0cf8dd8a7a1", "5dab087e624a8a4b79e17f8b83800ee66f3bb1292618b6fd1c2f8b27ff88e0eb"))
    base = (9).to_bytes(32, "little")
    assert crypto.x25519_shared(a, crypto.x25519_shared(b, base)) == crypto.x25519_shared(b, crypto.x25519_shared(a, base))
    assert crypto.x25519_shared(b, base).hex() == "de9edb7d7b7dc1b4d35b61c2ece435373f8343c85b78674dadfc7e146f882b4f"  # RFC 7748, 6.1
    seed = b"\x07" * 32
    assert crypto.montgomery_public(crypto.ed25519_public(seed)) == crypto.x25519_shared(crypto.montgomery_secret(seed), base)


def test_derivation_vector():
    got = crypto.hkdf_sha256(b"\x0b" * 22, bytes.fromhex("000102030405060708090a0b0c"), bytes.fromhex("f0f1f2f3f4f5f6f7f8f9"), 42)
    assert got.hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"  # RFC 5869, A.1


def test_sealing_and_wrapping(spark):
    key, nonce = b"k" * 32, b"n" * 12
    sealed = bytes(one(spark, crypto.seal(F.lit(key), F.lit(nonce), F.lit(b"secret"))))
    assert len(sealed) == 6 + 16
    assert bytes(one(spark, crypto.unseal(F.lit(key), F.lit(nonce), F.lit(sealed)))) == b"secret"
    assert one(spark, crypto.unseal(F.lit(b"w" * 32), F.lit(nonce), F.lit(sealed))) is None
    assert one(spark, crypto.unseal(F.lit(b"short"), F.lit(nonce), F.lit(sealed))) is None
    base = (9).to_bytes(32, "little")
    mine, theirs = b"a" * 32, b"b" * 32
    wrapped = bytes(one(spark, crypto.wrap(F.lit(key), F.lit(theirs), F.lit(crypto.x25519_shared(mine, base)), F.lit(nonce), "label", F.lit("me"))))
    get = lambda secret, name: one(spark, crypto.unwrap(F.lit(wrapped), F.lit(secret), F.lit(crypto.x25519_shared(theirs, base)), F.lit(nonce), "label", F.lit(name)))
    assert bytes(get(mine, "me")) == key and get(mine, "you") is None and get(theirs, "me") is None


# --- terms ---------------------------------------------------------------------------------------


def test_arithmetic_promotes_and_fails_softly(spark):
    xsd = terms.XSD
    a, b = terms.literal(7), terms.literal(2)
    assert one(spark, terms.arithmetic("/", a, b)).asDict() == {"kind": "literal", "value": "3.5", "datatype": xsd + "decimal", "language": None}
    assert one(spark, terms.arithmetic("+", a, b)).value == "9"
    assert one(spark, terms.arithmetic("/", a, terms.literal(0))) is None
    assert one(spark, terms.arithmetic("+", a, terms.literal("x"))) is None
    assert one(spark, terms.compare("<", terms.literal(10), terms.literal("9", xsd + "integer"))) is False
    assert one(spark, terms.compare("<", terms.literal("10"), terms.literal("9"))) is True
    assert one(spark, terms.truth(terms.literal(""))) is False and one(spark, terms.truth(terms.uri("urn:x"))) is None


def test_term_functions(spark):
    assert one(spark, terms.lang_matches(F.lit("en-GB"), "EN")) is True and one(spark, terms.lang_matches(F.lit(""), "*")) is False
    assert one(spark, terms.encode_for_uri(F.lit("a b/ü~*"))) == "a%20b%2F%C3%BC~%2A"
    assert [one(spark, terms.round_half_up(F.lit(x))) for x in (2.5, -2.5, 2.4)] == [3, -2, 2]
    assert one(spark, terms.datatype(terms.literal("x", language="en"))).endswith("langString")
    assert one(spark, terms.string_before(F.lit("abc"), "b")) == "a" and one(spark, terms.string_after(F.lit("abc"), "z")) == ""


# --- curve arithmetic on whole batches ------------------------------------------------------------


def _little(x: int) -> bytes:
    return x.to_bytes(32, "little")


def test_field_elements_of_a_batch():
    rng = np.random.default_rng(3)
    low = [0, 1, 2, 19, crypto.FIELD - 1, crypto.FIELD, crypto.FIELD + 1, 2**255 - 1]
    a = np.concatenate([np.frombuffer(b"".join(map(_little, low)), np.uint8).reshape(-1, 32), rng.integers(0, 256, (200, 32), dtype=np.uint8)])
    b = a[rng.permutation(len(a))]
    x, y = ([int.from_bytes(bytes(r), "little") % 2**255 for r in v] for v in (a, b))

    def told(h):
        return [int.from_bytes(bytes(r), "little") for r in curve.canonical(h)]

    f, g = curve.limbs(a), curve.limbs(b)
    assert told(f) == [v % crypto.FIELD for v in x]
    assert told(curve.product(f, g)) == [v * w % crypto.FIELD for v, w in zip(x, y)]
    assert told(f - g) == [(v - w) % crypto.FIELD for v, w in zip(x, y)]
    assert told(curve.inverse(f)) == [pow(v, crypto.FIELD - 2, crypto.FIELD) for v in x]
    near, far = curve.carried(f.copy()), curve.carried(g.copy())  # sums of three are the widest that a product allows
    assert told(curve.product(near - 2 * far, far - 2 * near)) == [(v - 2 * w) * (w - 2 * v) % crypto.FIELD for v, w in zip(x, y)]


def test_batches_agree_with_rows():
    """Every verdict, signature and secret of a batch is that of its row alone, odd keys and signatures included."""
    seeds = [bytes([k]) * 32 for k in range(70)] + [b"short", b""]
    messages = [bytes([k]) * (k % 40) for k in range(72)]
    publics = crypto.ed25519_publics(seeds)
    assert publics == [crypto.ed25519_public(s) for s in seeds]
    signed = crypto.ed25519_signatures(messages, seeds)
    assert signed == [crypto.ed25519_sign(m, s) for m, s in zip(messages, seeds)]
    rows = list(zip(messages, signed, publics))
    rows += [(m + b"!", s, p) for m, s, p in rows[:5]] + [(m, s[:32] + _little(int.from_bytes(s[32:], "little") + crypto.ORDER), p) for m, s, p in rows[:5]]
    odd = [_little(v) for v in (0, 1, 2, crypto.FIELD - 1, crypto.FIELD, crypto.FIELD + 1, 2**255 - 1, 1 + 2**255, crypto.FIELD - 1 + 2**255)]
    rows += [(b"m", first + _little(s), key) for key in odd for first in odd for s in (0, 1)]
    assert crypto.ed25519_verdicts(*zip(*rows)) == [crypto.ed25519_verify(*r) for r in rows]
    assert sum(crypto.ed25519_verdicts(*zip(*rows))) > 72  # small points verify, as row by row
    secrets = [bytes([255 - k]) * 32 for k in range(60)]
    points = [crypto.montgomery_public(p) for p in publics[:50]] + odd + [b"\xff" * 32]
    assert crypto.x25519_secrets(secrets, points) == [crypto.x25519_shared(s, p) for s, p in zip(secrets, points)]
    assert crypto.montgomery_publics(odd + publics) == [crypto.montgomery_public(p) for p in odd + publics]


def test_signatures_of_a_column(spark):
    rows = [(k, f"text {k}", None if k == 7 else bytes([k]) * 32) for k in range(120)] + [(200, "x", b"\1\2")]
    df = spark.createDataFrame(rows, "k long, text string, seed binary").coalesce(1)
    made = df.select("k", "text", crypto.sign(F.col("text"), F.col("seed")).alias("s"), crypto.public_key(F.col("seed")).alias("p"))
    wrong = F.when(F.col("k") % 3 == 0, F.substring("s", 1, 63)).otherwise(F.col("s"))
    told = {r.k: (r.ok, r.cut) for r in made.select("k", crypto.verify_signature(F.col("text"), F.col("s"), F.col("p")).alias("ok"), crypto.verify_signature(F.col("text"), wrong, F.col("p")).alias("cut")).collect()}
    assert told == {k: (s is not None, s is not None and k % 3 != 0) for k, _, s in rows}
