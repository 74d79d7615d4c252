"""Graphs, canonical forms, chains, resolution and privacy modes on small made-up stores."""

from __future__ import annotations

import hashlib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from attestry.functions import crypto, terms, text
from attestry.operators import blobs, canonical, chains, hardening, manifests, patterns, publish, quads, resolve
from attestry.operators.patterns import Literal, Var
from attestry.sources import graphs, packages

PERSON = {
    "@context": {"schema": "http://schema.org/", "xsd": "http://www.w3.org/2001/XMLSchema#", "born": {"@id": "schema:birthDate", "@type": "xsd:date"}},
    "@id": "urn:p:1", "@type": "schema:Person", "schema:name": "Ada", "born": "1988-03-14", "schema:age": 36, "schema:score": 1.5, "schema:ok": True,
    "schema:address": {"@type": "schema:PostalAddress", "schema:city": "Linz", "schema:tag": [{"@value": "x", "@language": "EN"}, {"@list": ["a", "b"]}]},
}


# --- graphs --------------------------------------------------------------------------------------


def test_json_ld(spark):
    docs = spark.createDataFrame([("d1", json.dumps(PERSON)), ("d2", "{"), ("d3", '{"@context":"https://far.example/","@id":"urn:x"}'), ("d4", None), ("d5", "{}")], "doc_id string, text string")
    lines = graphs.json_ld_lines(docs, "doc_id", "text")
    assert {r.doc_id for r in lines.where("error is not null").collect()} == {"d2", "d3"}
    table = graphs.load_json_ld(docs, "doc_id", "text")
    assert table.count() == 6 + 1 + 4 + 4  # own, link, address, list
    got = patterns.bgp(table, [(Var("x"), "a", "http://schema.org/Person"), (Var("x"), "http://schema.org/birthDate", Var("d")), (Var("x"), "http://schema.org/address", Var("b")), (Var("b"), "http://schema.org/city", Var("c"))]).collect()
    assert [(r.d.value, r.d.datatype, r.c.value) for r in got] == [("1988-03-14", "http://www.w3.org/2001/XMLSchema#date", "Linz")]
    tags = patterns.pattern(table, Var("b"), "http://schema.org/tag", Literal("x", language="en"))
    assert tags.count() == 1
    far = graphs.json_ld_lines(docs, "doc_id", "text", registry={"https://far.example/": {"@context": {}}})
    assert far.where("doc_id = 'd3' and error is not null").count() == 0


def test_json_ld_of_any_size_and_with_errors(spark):
    large = {"@context": {"@vocab": "urn:v:"}, "@id": "urn:x", "has": [{"n": k} for k in range(1500)]}
    docs = spark.createDataFrame([("d1", json.dumps(large)), ("d2", "{")], "doc_id string, text string")
    assert graphs.build_graph(docs.where("doc_id = 'd1'"), "doc_id", "text").count() == 3000
    assert graphs.load_json_ld(docs, "doc_id", "text").count() == 3000
    assert [r.doc_id for r in graphs.load_errors(docs, "doc_id", "text").collect()] == ["d2"]
    assert graphs.build_graph(docs, "doc_id", "text", strict=False).count() == 3000
    with pytest.raises(Exception, match="document 'd2'"):
        graphs.build_graph(docs, "doc_id", "text").count()


def test_graph_factory(spark):
    docs = spark.createDataFrame([("d", '<urn:a> <urn:p> "x\\"y"@en <urn:g> .\n# no\n\n_:b <urn:p> _:b .')], "doc_id string, text string")
    table = graphs.build_graph(docs, "doc_id", "text", "application/n-quads")
    assert {(r.graph, r.s, r.o) for r in table.collect()} == {("urn:g", "urn:a", 'x"y'), (None, "d/b", "d/b")}
    for mode in ("materialized", "runtime"):
        with pytest.raises(NotImplementedError):
            graphs.build_graph(docs, "doc_id", "text", mode=mode)
    with pytest.raises(ValueError):
        graphs.build_graph(docs, "doc_id", "text", "text/html")
    trap = spark.createDataFrame([("t", "<urn:A> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <urn:B> .\n<urn:B> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <urn:C> .\n<urn:i> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <urn:A> .")], "doc_id string, text string")
    table = graphs.load_n_quads(trap, "doc_id", "text")
    kinds = lambda t: patterns.pattern(t, "urn:i", "a", Var("k")).count()
    assert kinds(table) == 1 and kinds(graphs.subclass_closure(table)) == 3


def canonical_texts(spark, docs):
    rows = [(i, line) for i, lines in enumerate(docs) for line in lines]
    return {r.doc_id: (r.text, r.error) for r in canonical.canonicalise(spark.createDataFrame(rows, "doc_id long, quad string")).collect()}


def test_canonical_form_does_not_depend_on_names_or_order(spark):
    rng = random.Random(3)
    shapes = [
        [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a")],  # a circle: all alike
        [("a", "p", "b"), ("b", "p", "a"), ("c", "p", "d"), ("d", "p", "c")],
        [("a", "p", "x"), ("b", "p", "x"), ("x", "q", "y")],
        [("a", "p", "b"), ("a", "p", "c"), ("b", "q", "d"), ("c", "q", "e"), ("d", "r", "a")],
        [("a", "p", "a"), ("b", "p", "b"), ("a", "q", "b")],
    ]
    docs, of = [], []
    for k, shape in enumerate(shapes):
        for _ in range(4):
            names = sorted({x for s, _, o in shape for x in (s, o)})
            new = dict(zip(names, rng.sample(["m", "n", "o", "pp", "q1", "zz", "r7"], len(names))))
            lines = [f"_:{new[s]} <urn:{p}> _:{new[o]} ." for s, p, o in shape] + ['<urn:s> <urn:t> "_:a" .']
            docs.append(rng.sample(lines, len(lines)))
            of.append(k)
    got = canonical_texts(spark, docs)
    texts = {}
    for i, k in enumerate(of):
        assert got[i][1] is None
        texts.setdefault(k, set()).add(got[i][0])
    assert all(len(t) == 1 for t in texts.values()) and len({t for s in texts.values() for t in s}) == len(shapes)
    assert '<urn:s> <urn:t> "_:a" .\n' in texts[0].pop()


def test_canonical_form_by_brute_force(spark):
    """Two graphs of three blank nodes get equal texts exactly where a renaming maps one to the other."""
    edges = list(itertools.product("abc", repeat=2))
    rng = random.Random(1)
    docs = [sorted(rng.sample(edges, rng.randint(1, 5))) for _ in range(40)]
    got = canonical_texts(spark, [[f"_:{s} <urn:p> _:{o} ." for s, o in d] for d in docs])

    def shape(d):
        return min(tuple(sorted((m[s], m[o]) for s, o in d)) for m in (dict(zip("abc", p)) for p in itertools.permutations("abc")))

    for i, j in itertools.combinations(range(len(docs)), 2):
        assert (shape(docs[i]) == shape(docs[j])) == (got[i][0] == got[j][0])


def test_canonical_limits(spark):
    many = [f"_:n{i} <urn:p> <urn:x{i}> ." for i in range(20)]
    rows = spark.createDataFrame([(1, x) for x in many] + [(2, "_:a <urn:p> <urn:o> .")], "doc_id long, quad string")
    got = {r.doc_id: r for r in canonical.canonicalise(rows, most_nodes=10).collect()}
    assert got[1].text is None and got[1].error == "too many blank nodes" and got[2].text == "_:c14n0 <urn:p> <urn:o> .\n"


def test_patch_and_difference(spark):
    base = spark.createDataFrame([("a",), ("b",)], "quad string")
    ops = spark.createDataFrame([(1, "remove", "a"), (2, "add", "c"), (3, "remove", "zz"), (4, "add", "a"), (5, "remove", "c")], "seq int, op string, quad string")
    assert {r.quad for r in quads.apply_patch(base, ops).collect()} == {"a", "b"}
    assert {tuple(r) for r in quads.difference(base, spark.createDataFrame([("b",), ("d",)], "quad string")).collect()} == {("remove", "a"), ("add", "d")}


# --- stores and resolution -----------------------------------------------------------------------

SEED, OTHER = b"\x01" * 32, b"\x02" * 32
PK = crypto.ed25519_public(SEED)
B58 = text.BASE58


def b58(data):
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = B58[r] + out
    return out


AUTHORITY = "key:ed25519:z" + b58(PK)
URI = f"vk://{AUTHORITY}/data/person"


def jcs(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def address(data):
    return "sha256:" + hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def signed(doc, seed=SEED, key="key-1"):
    sig = "z" + b58(crypto.ed25519_sign(jcs(doc).encode(), seed))
    block = {"type": "Ed25519Signature2020", "canonicalization": "JCS", "created": "2025-01-01T00:00:00Z", "verificationMethod": f"vk://{AUTHORITY}/key/main#{key}", "proofPurpose": "assertionMethod", "proofValue": sig}
    return jcs({**doc, "vk:signature": block})


def manifest(version, content, chain=None, delta=None, seed=SEED, uri=URI, profile="JCS", created="2025-01-01T00:00:00Z", **more):
    doc = {"@id": uri, "@type": "vk:ResolutionManifest", "vk:version": str(version), "vk:branch": "main", "vk:timing": {"created": created}, **more}
    if content is not None:
        doc["vk:content"] = {"hash": address(content), "addressing": "raw-sha256", "format": "application/json", "size": len(content), "canonicalization": profile}
    if chain:
        doc["vk:chain"] = chain
    if delta:
        doc["vk:delta"] = delta
    return signed(doc, seed)


def store(spark, *items):
    """Blobs under their addresses; a pair is stored under another one's."""
    rows = [(address(x[0]), x[1]) if isinstance(x, tuple) else (address(x), x) for x in items]
    return spark.createDataFrame([(h, x if isinstance(x, bytes) else x.encode()) for h, x in rows], "hash string, bytes binary").dropDuplicates(["hash"])


def chain_of_three(bad_delta=False, broken=None):
    contents = [jcs({"n": "a"}), jcs({"n": "b"}), jcs({"n": "b", "x": 1})]
    ops = jcs([{"op": "replace", "path": "/n", "value": "WRONG" if bad_delta else "b"}])
    delta = {"hash": address(ops), "format": "application/json-patch+json", "appliesTo": address(contents[0]), "operations": 1}
    v1 = manifest(1, contents[0])
    link = {"previous": address(v1), "previousBranch": "main", "genesisHash": address(v1), "depth": 2}
    v2 = manifest(2, contents[1], {**link, **(broken or {})}, delta)
    v3 = manifest(3, contents[2], {"previous": address(v2), "previousBranch": "main", "genesisHash": address(v1), "depth": (broken or {}).get("depth", 2) + 1})
    return [v1, v2, v3], contents, ops


def ask(spark, rows, blob_table, **options):
    requests = spark.createDataFrame(rows, "uri string, manifest_hash string, public_key binary")
    return [(r.ok, r.error_code, r.message, list(r.warnings or [])) for r in resolve.resolve(requests, blob_table, **options).orderBy("uri", "manifest_hash").collect()]


def test_resolve_chain(spark):
    versions, contents, ops = chain_of_three()
    got = ask(spark, [(URI, address(versions[2]), PK)], store(spark, *versions, *contents, ops))
    assert got == [(True, None, None, [])]


@pytest.mark.parametrize("change, reason", [({"depth": 7}, "depth"), ({"genesisHash": "sha256:0"}, "genesis hash"), ({"previousBranch": "x"}, "branch")])
def test_resolve_finds_broken_links(spark, change, reason):
    versions, contents, ops = chain_of_three(broken=change)
    got = ask(spark, [(URI, address(versions[2]), PK)], store(spark, *versions, *contents, ops))
    assert got[0][:3] == (False, "CHAIN_VERIFICATION_FAILED", reason)


def test_resolve_delta_falls_back_to_content(spark):
    versions, contents, ops = chain_of_three(bad_delta=True)
    whole = store(spark, *versions, *contents, ops)
    assert ask(spark, [(URI, address(versions[2]), PK)], whole) == [(True, None, None, ["delta failed, content holds"])]
    tampered = store(spark, *versions, contents[0], (contents[1], b"tampered"), contents[2], ops)
    assert ask(spark, [(URI, address(versions[2]), PK)], tampered)[0][:3] == (False, "CHAIN_VERIFICATION_FAILED", "delta and content")


def test_resolve_errors_in_order(spark):
    c = jcs({"n": 1})
    good, forged, elsewhere = manifest(1, c), manifest(1, c, seed=OTHER), manifest(1, c, uri=URI + "2")
    lost, asym = manifest(1, jcs({"n": 2})), manifest(1, c, profile="URDNA2015")
    other = f"vk://{AUTHORITY}/data"
    blob_table = store(spark, good, forged, elsewhere, lost, asym, c, ("altered", b"x"), "no manifest")
    rows = [("bad", address(good), PK), (URI, address(good), crypto.ed25519_public(OTHER)), (URI, "sha256:none", PK), (URI, address("altered"), PK), (URI, address("no manifest"), PK), (URI, address(elsewhere), PK), (URI, address(forged), PK), (URI, address(asym), PK), (URI, address(lost), PK), (URI, address(good), PK), (other, address(good), PK)]
    requests = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "uri string, manifest_hash string, public_key binary, i int")
    codes = [None] * len(rows)
    for r in resolve.resolve(requests, blob_table).collect():
        for i, (uri, h, _) in enumerate(rows):
            if (uri, h) == (r.uri, r.manifest_hash):
                codes[i] = (codes[i] or set()) | {r.error_code}
    assert codes[0] == {"PARSE_ERROR"} and codes[1] == codes[9] == {"AUTHORITY_NOT_FOUND", None}
    assert [codes[i] for i in (2, 3, 4, 5, 6, 7, 8, 10)] == [{x} for x in ("MANIFEST_NOT_FOUND", "STORAGE_CORRUPTION", "MANIFEST_MALFORMED", "IDENTITY_MISMATCH", "SIGNATURE_VERIFICATION_FAILED", "SIGNATURE_VERIFICATION_FAILED", "CONTENT_NOT_FOUND", "PARSE_ERROR")]


def test_resolve_with_key_documents(spark):
    c = jcs({"n": 1})
    doc = manifest(1, c, created="2025-08-01T00:00:00Z")
    blob_table = store(spark, doc, c)

    def document(name):
        lists = {n: "cast(array() AS array<struct<id:string,public_key:binary,rotated_at:timestamp,verify_until:timestamp,invalid_after:timestamp>>)" for n in ("active", "rotated", "revoked")}
        one = f"array(named_struct('id', 'vk://a#key-1', 'public_key', x'{PK.hex()}', 'rotated_at', timestamp'2025-07-01', 'verify_until', timestamp'2025-12-31', 'invalid_after', timestamp'2025-02-15'))"
        if name:
            lists[name] = one
        return spark.sql(f"SELECT '{AUTHORITY}' AS authority, {', '.join(f'{v} AS {k}' for k, v in lists.items())}, named_struct('grace', 'P183D') AS policies")

    at = lambda s: F.lit(s).cast("timestamp")
    row = [(URI, address(doc), PK)]
    assert ask(spark, row, blob_table, key_documents=document("active"), at=at("2026-01-01"))[0][:2] == (True, None)
    got = ask(spark, row, blob_table, key_documents=document("rotated"), at=at("2025-12-31"))[0]
    assert got[0] and len(got[3]) == 1
    assert ask(spark, row, blob_table, key_documents=document("rotated"), at=at("2026-01-01"))[0][1] == "KEY_EXPIRED"
    assert ask(spark, row, blob_table, key_documents=document("revoked"), at=at("2026-01-01"))[0][1] == "KEY_REVOKED"
    assert ask(spark, row, blob_table, key_documents=document(None), at=at("2026-01-01"))[0][1] == "KEY_UNKNOWN"


def test_build_sign_read_round_trip(spark):
    content = F.lit(jcs({"n": 1}))
    built = manifests.build(F.lit(URI), F.lit(3), F.lit("main"), F.lit("2025-01-01T00:00:00Z"), manifests.content_record(content))
    doc = spark.range(1).select(manifests.sign(built, F.lit(SEED), F.lit("key-1"), F.lit("2025-01-01T00:00:00Z")).alias("doc")).first().doc
    assert json.loads(doc)["vk:version"] == "3" and "vk:chain" not in json.loads(doc)
    got = resolve.signed(manifests.read(store(spark, doc))).first()
    assert got.signature_ok and got.version == "3" and got.id == URI
    given = spark.createDataFrame([(doc,)], "doc string")
    with pytest.raises(Exception, match="profile"):
        given.select(manifests.sign(F.col("doc"), F.lit(SEED), F.lit("k"), F.lit("t"), "URDNA2015", F.col("doc"))).collect()
    with pytest.raises(ValueError, match="canonical text"):
        manifests.sign(built, F.lit(SEED), F.lit("k"), F.lit("t"), "URDNA2015")


def test_rotation_proof(spark):
    new = crypto.ed25519_public(OTHER)
    claim = jcs({"oldKeyId": "a#key-1", "newKeyId": "a#key-2", "rotatedAt": "2025-07-01T00:00:00Z", "reason": "scheduled"}).encode()
    proof = [("old-key-authorizes-rotation", "z" + b58(crypto.ed25519_sign(claim, SEED))), ("new-key-confirms-rotation", "z" + b58(crypto.ed25519_sign(claim, OTHER)))]
    schema = "r struct<id:string,rotated_to:string,rotated_at:string,reason:string,public_key:binary,proof:array<struct<purpose:string,proofValue:string>>>"
    for p, reason, want in ((proof, "scheduled", True), (proof[:1], "scheduled", False), (proof, "other", False), ([proof[0], (proof[1][0], proof[0][1])], "scheduled", False)):
        row = spark.createDataFrame([(("a#key-1", "a#key-2", "2025-07-01T00:00:00Z", reason, PK, p),)], schema)
        assert row.select(manifests.rotation_valid(F.col("r"), F.lit(new)).alias("v")).first().v is want


def test_blob_stores(spark):
    a = store(spark, "x", "y", ("z", b"not z"))
    assert {r.hash for r in blobs.corrupted(a).collect()} == {address("z")} and blobs.intact(a).count() == 2
    assert blobs.put(a, store(spark, "z", "w")).count() == 4 and blobs.without(a, store(spark, "x")).count() == 2


def test_packages_round_trip(spark):
    c = jcs({"n": 1})
    doc = manifest(1, c)
    entries = store(spark, doc, c).withColumn("uri", F.lit(URI))
    heads = spark.createDataFrame([(URI, AUTHORITY, PK)], "uri string, authority string, public_key binary")
    packed = packages.export(heads, entries)
    got = packages.load(packed).collect()
    assert {(r.hash, r.error) for r in got} == {(address(doc), None), (address(c), None)}
    bad = packed.select(F.regexp_replace("package", '"data":"[A-Za-z0-9]{4}', '"data":"AAAA').alias("package"))
    assert [r.error for r in packages.load(bad).collect()] == ["integrity"]
    assert [r.error for r in packages.load(packed.select(F.replace("package", F.lit('"version":1'), F.lit('"version":2')).alias("package"))).collect()] == ["version"]


# --- privacy modes -------------------------------------------------------------------------------

BASE = (9).to_bytes(32, "little")
READER, SENDER, NONCE = b"\x05" * 32, b"\x06" * 32, b"\x07" * 12


def sealed(spark, key, data):
    return bytes(spark.range(1).select(crypto.seal(F.lit(key), F.lit(NONCE), F.lit(data)).alias("x")).first().x)


def wrapped(spark, key, label, name="me"):
    return sealed(spark, crypto.hkdf_sha256(crypto.x25519_shared(SENDER, crypto.x25519_shared(READER, BASE)), NONCE, (label + name).encode()), key).hex()


def private(mode, **parameters):
    return {"vk:privacy": {"mode": mode, "parameters": parameters}}


def ask_private(spark, doc, blob_table, recipient=None, secret=None, **options):
    requests = spark.createDataFrame([(URI, address(doc), PK, recipient, secret)], "uri string, manifest_hash string, public_key binary, recipient string, secret binary")
    return resolve.resolve_private(requests, blob_table, **options).first()


def test_possession_and_unknown_modes(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    doc = manifest(1, "never stored", **private("proof-of-possession", refreshPolicy="P30D"))
    fresh = ask_private(spark, doc, store(spark, doc), at=at("2025-01-15"))
    assert fresh.verified and fresh.content_status == "private-custody-asserted" and list(fresh.warnings) == []
    assert list(ask_private(spark, doc, store(spark, doc), at=at("2025-03-01")).warnings) == ["custody assertion is stale"]
    odd = manifest(1, "x", **private("sealed-by-wax"))
    got = ask_private(spark, odd, store(spark, odd))
    assert got.verified and got.content_status == "unsupported-mode" and list(got.warnings) == ["unsupported privacy mode"]
    forged = manifest(1, "x", seed=OTHER, **private("proof-of-possession"))
    assert not ask_private(spark, forged, store(spark, forged)).verified


def test_encrypted(spark):
    plain = b"plain content"
    box = sealed(spark, b"c" * 32, plain)
    share = {"id": "me", "encryptedKey": wrapped(spark, b"c" * 32, resolve.CONTENT_LABEL)}
    parameters = {"iv": NONCE.hex(), "ephemeralPublicKey": crypto.x25519_shared(SENDER, BASE).hex(), "plaintextHash": address(plain), "recipients": [share]}
    doc = manifest(1, box, **private("encrypted", **parameters))
    blob_table = store(spark, doc, box)
    assert ask_private(spark, doc, blob_table).content_status == "ciphertext-verified"
    got = ask_private(spark, doc, blob_table, "me", READER)
    assert (got.verified, got.content_status, bytes(got.content), list(got.warnings)) == (True, "decrypted-verified", plain, [])
    for name, secret in (("me", SENDER), ("you", READER)):
        got = ask_private(spark, doc, blob_table, name, secret)
        assert got.verified and got.content_status == "decryption-failed"
    assert not ask_private(spark, doc, store(spark, doc)).verified
    hidden = manifest(1, box, **private("anonymous", authorityType="ephemeral", contentVisibility="encrypted", **parameters))
    got = ask_private(spark, hidden, store(spark, hidden, box), "me", READER)
    assert (got.privacy_mode, got.identity_type, got.content_status) == ("anonymous", "anonymous-ephemeral", "decrypted-verified")


def test_selective_disclosure(spark):
    import base64
    import hmac

    salt, key = b"s" * 32, b"h" * 32
    statements = [f"<urn:{i}> <urn:p> \"{i}\" ." for i in range(4)]
    index = [hashlib.sha256(salt + s.encode()).hexdigest() for s in statements]
    root = hashlib.sha256(bytes.fromhex("".join(index))).hexdigest()
    tags = [hmac.new(key, salt + s.encode(), "sha256").hexdigest() for s in statements]

    def case(mandatory=(0, 2), shown=None, tags=tags, root=root):
        blob = jcs({"mandatoryNQuads": shown or [statements[i] for i in mandatory], "statementIndex": index, "hmacTags": tags})
        share = {"ephemeralPublicKey": crypto.x25519_shared(SENDER, BASE).hex(), "iv": NONCE.hex(), "recipients": [{"id": "me", "encryptedHmacKey": wrapped(spark, key, resolve.HMAC_LABEL), "disclosedStatements": "all"}]}
        doc = manifest(1, blob, **private("selective-disclosure", statementCount=4, indexSalt=base64.urlsafe_b64encode(salt).decode().rstrip("="), indexRoot=root, mandatoryStatements=list(mandatory), hmacKeyRecipients=share))
        return doc, store(spark, doc, blob)

    doc, blob_table = case()
    for who in ((None, None), ("me", READER)):
        got = ask_private(spark, doc, blob_table, *who)
        assert got.verified and got.content_status == "partial-disclosure" and list(got.warnings) == [] and list(got.disclosed) == [statements[0], statements[2]]
    assert list(ask_private(spark, doc, blob_table, "me", SENDER).warnings) == ["HMAC key decryption failed"]
    assert list(ask_private(spark, *case(shown=[statements[0], "forged"]), "me", READER).warnings) == ["mandatory statement not in the index: 2", "tag verification failed: 2"]
    assert list(ask_private(spark, *case(shown=[statements[0]])).warnings) == ["mandatory statement missing: 2"]
    assert list(ask_private(spark, *case(root="0" * 64)).warnings) == ["index root mismatch"]
    assert list(ask_private(spark, *case(tags=[tags[1], *tags[1:]]), "me", READER).warnings) == ["tag verification failed: 0"]


def test_attestation(spark):
    about = manifest(1, jcs({"n": 1}))
    block = {"subject": {"authority": AUTHORITY, "manifestHash": address(about)}, "claim": {"property": "p", "value": True, "validUntil": "2025-06-01T00:00:00Z"}, "evidence": {}}
    doc = manifest(1, None, **private("attestation"), **{"vk:attestation": block})
    at = lambda s: F.lit(s).cast("timestamp")
    got = ask_private(spark, doc, store(spark, doc, about), at=at("2025-05-01"))
    assert (got.verified, got.trust, got.content_status, list(got.warnings)) == (True, "full", "attestation-verified", [])
    assert ask_private(spark, doc, store(spark, doc), at=at("2025-05-01")).trust == "partial"
    assert list(ask_private(spark, doc, store(spark, doc, about), at=at("2025-07-01")).warnings) == ["attestation expired"]
    forged = manifest(1, None, seed=OTHER, **private("attestation"), **{"vk:attestation": block})
    assert ask_private(spark, forged, store(spark, forged, about)).trust == "unverifiable"


def test_attestation_subjects_are_checked_with_the_given_keys(spark):
    about = manifest(1, jcs({"n": 1}))
    block = {"subject": {"authority": AUTHORITY, "manifestHash": address(about)}, "claim": {"property": "p", "value": True}, "evidence": {}}
    doc = manifest(1, None, **private("attestation"), **{"vk:attestation": block})
    for keys, want in (([PK], "full"), ([crypto.ed25519_public(OTHER)], "partial"), ([crypto.ed25519_public(OTHER), PK], "full"), ([], "partial")):
        subjects = spark.createDataFrame([(AUTHORITY, k) for k in keys], "authority string, public_key binary")
        got = ask_private(spark, doc, store(spark, doc, about), subjects=subjects)
        assert got.trust == want and (want == "full") == (list(got.warnings) == [])


def test_private_walks_follow_modes_and_addressing(spark):
    def chain(first, second, **content):
        one = manifest(1, "a", **(private(first) if first else {}))
        two = manifest(2, "b", {"previous": address(one), "previousBranch": "main", "genesisHash": address(one), "depth": 2}, **private(second))
        return one, two

    for first, second, ok in (("proof-of-possession", "public", True), ("public", "proof-of-possession", False), (None, "encrypted", False), ("proof-of-possession", "sealed-by-wax", True)):
        one, two = chain(first, second)
        got = ask_private(spark, two, store(spark, one, two, "b", "a"))
        assert any("privacy mode rises" in w for w in got.warnings) is not ok
        judged = resolve.signed(manifests.read(store(spark, one, two)))
        heads = spark.createDataFrame([(address(two),)], "manifest_hash string")
        assert [tuple(r)[1:] for r in resolve.mode_changes(heads, judged).collect()] == [(2, first or "public", second)]


def test_only_what_requests_reach_is_verified(spark):
    one = manifest(1, "a")
    two = manifest(2, "b", {"previous": address(one), "previousBranch": "main", "genesisHash": address(one), "depth": 2})
    other = manifest(1, "c")
    requests = spark.createDataFrame([(address(two),), ("sha256:none",), (None,)], "manifest_hash string")
    assert {r.hash for r in resolve.reachable(requests, store(spark, one, two, other, "a", "b")).collect()} == {address(one), address(two)}


def test_broken_statements_are_errors(spark):
    good = '<urn:a> <urn:p> "x" .'
    docs = spark.createDataFrame([(1, good), (2, good + "\n<urn:a> <urn:p> broken ."), (3, '<urn:a> <urn:p> "\\q" .'), (4, "# nothing"), (5, '<urn:a><urn:p>"' + "y" * 100_000 + '\\n".# said')], "doc_id long, text string")
    lines = quads.quad_set(docs, "text", "doc_id")
    got = {r.doc_id: (r.text, r.error) for r in canonical.canonicalise(lines).collect()}
    assert got[1] == (good + "\n", None) and got[2] == got[3] == (None, "malformed statement") and got[5][1] is None and set(got) == {1, 2, 3, 5}
    assert {r.doc_id for r in graphs.load_n_quads(docs, "doc_id", "text").select("doc_id").collect()} == {"1", "5"}
    assert {r.doc_id for r in graphs.load_errors(docs, "doc_id", "text", "application/n-quads").collect()} == {2, 3}
    with pytest.raises(Exception, match="malformed statement"):
        graphs.build_graph(docs, "doc_id", "text", "application/n-quads").count()


def test_one_literal_has_one_canonical_text(spark):
    same = ['"\\u00e9\\t\\"\\\\u"', '"é\t\\"\\\\u"', '"\\U000000E9\\u0009\\u0022\\u005Cu"^^<http://www.w3.org/2001/XMLSchema#string>']
    docs = spark.createDataFrame([(i, f"<urn:\\u00e9> <urn:p> {x} .") for i, x in enumerate(same)], "doc_id long, text string")
    lines = quads.quad_set(docs, "text", "doc_id")
    assert {r.text for r in canonical.canonicalise(lines).collect()} == {'<urn:é> <urn:p> "é\t\\"\\\\u" .\n'}
    assert {(r.s, r.o, r.o_dt) for r in quads.parse(lines).collect()} == {("urn:é", 'é\t"\\u', None)}


def test_file_sink_and_empty_store(spark, tmp_path):
    made = store(spark, "x", "y")
    assert packages.write_files(made, tmp_path.as_uri()) == 2 == packages.write_files(made, tmp_path.as_uri())
    assert {(r.hash, bytes(r.bytes)) for r in packages.scan_files(spark, str(tmp_path)).collect()} == {(address("x"), b"x"), (address("y"), b"y")}
    assert blobs.emptied(made).count() == 0 and blobs.emptied(made).columns == made.columns


def test_packages_hold_what_the_mode_needs(spark):
    c = jcs({"n": 1})
    about = manifest(1, c)
    block = {"subject": {"authority": AUTHORITY, "manifestHash": address(about)}, "claim": {"property": "p", "value": True}, "evidence": {}}
    doc, kept = manifest(1, None, **private("attestation"), **{"vk:attestation": block}), manifest(1, "never stored", **private("proof-of-possession"))
    heads = spark.createDataFrame([("a", address(doc)), ("p", address(kept)), ("m", address(about))], "uri string, manifest_hash string")
    got = {(r.uri, r.hash) for r in packages.published(heads, store(spark, doc, about, kept, c)).collect()}
    assert got == {("a", address(doc)), ("a", address(about)), ("a", address(c)), ("p", address(kept)), ("m", address(about)), ("m", address(c))}


# --- publishing ----------------------------------------------------------------------------------


def agreement_public(secret):
    return crypto.x25519_shared(secret, BASE)


def test_sealed_content_for_many_recipients(spark):
    plain = jcs({"n": 1}).encode()
    contents = spark.createDataFrame([(1, plain, b"c" * 32, NONCE, SENDER)], "id long, plain binary, key binary, nonce binary, sender binary")
    readers = {"me": READER, "you": b"\x08" * 32}
    recipients = spark.createDataFrame([(1, n, agreement_public(s)) for n, s in readers.items()], "id long, recipient string, public_key binary")
    sealed_rows = publish.encrypt(contents, recipients)
    built = publish.build_encrypted(F.lit(URI), F.lit(1), F.lit("2025-01-01T00:00:00Z"), F.lit("application/json"))
    row = sealed_rows.select("*", manifests.sign(built, F.lit(SEED), F.lit("key-1"), F.lit("2025-01-01T00:00:00Z")).alias("doc")).first()
    assert row.plaintext_hash == address(plain.decode()) and [r.id for r in row.recipients] == ["me", "you"]
    blob_table = spark.createDataFrame([(address(row.doc), row.doc.encode()), (row.ciphertext_hash, bytes(row.ciphertext))], "hash string, bytes binary")
    for name, secret in readers.items():
        got = ask_private(spark, row.doc, blob_table, name, secret)
        assert (got.content_status, bytes(got.content)) == ("decrypted-verified", plain)
    with pytest.raises(Exception, match="without a recipient"):
        publish.encrypt(contents, recipients.where("false")).collect()


def test_disclosure_manifests_and_their_shares(spark):
    keys_of = spark.createDataFrame([(1, b"h" * 32, NONCE, SENDER)], "id long, hmac_key binary, nonce binary, sender binary")
    recipients = spark.createDataFrame([(1, "me", agreement_public(READER), None), (1, "you", agreement_public(OTHER), [0, 2])], "id long, recipient string, public_key binary, statements array<int>")
    shares = publish.share_index_key(keys_of, recipients)
    made = publish.build_disclosure(F.lit(URI), F.lit(1), F.lit("t"), F.lit("blob"), F.lit(4), F.lit(b"s" * 32), F.lit("00"), F.array(F.lit(0)))
    doc = json.loads(shares.select(made.alias("d")).first().d)
    told = doc["vk:privacy"]["parameters"]
    assert doc["vk:content"]["availability"] == "partial" and doc["vk:content"]["canonicalization"] == "URDNA2015"
    assert [(r["id"], r["disclosedStatements"]) for r in told["hmacKeyRecipients"]["recipients"]] == [("me", "all"), ("you", "[0,2]")]
    with pytest.raises(ValueError, match="graph profile"):
        publish.build_disclosure(F.lit(URI), F.lit(1), F.lit("t"), F.lit("b"), F.lit(4), F.lit(b"s"), F.lit("00"), F.array(F.lit(0)), "JCS")


def test_attestation_and_key_document_builders(spark):
    subject, claim = F.struct(F.lit("vk://a").alias("authority"), F.lit("sha256:x").alias("manifestHash")), F.struct(F.lit("p").alias("property"), F.lit(True).alias("value"))
    made = publish.build_attestation(F.lit(AUTHORITY), F.lit("one"), F.lit(1), F.lit("t"), subject, claim, F.struct(F.lit("seen").alias("method")))
    whole = spark.range(1).select(manifests.sign(made, F.lit(SEED), F.lit("key-1"), F.lit("t")).alias("d")).first().d
    doc = json.loads(whole)
    assert doc["@id"] == f"vk://{AUTHORITY}/attestation/one" and "vk:content" not in doc and doc["@type"] == "vk:AttestationManifest"
    assert resolve.signed(manifests.read(store(spark, whole))).first().signature_ok
    active = F.array(F.struct(F.lit("key-1").alias("@id")))
    made = publish.key_document(F.lit(AUTHORITY), F.lit(2), active, F.struct(F.lit("P30D").alias("gracePeriodAfterRotation")))
    doc = json.loads(spark.range(1).select(made.alias("d")).first().d)
    assert doc["@id"] == f"vk://{AUTHORITY}/key/main" and doc["vk:activeKeys"] == [{"@id": "key-1"}] and doc["vk:rotatedKeys"] == doc["vk:revokedKeys"] == []
    signed_doc = spark.range(1).select(manifests.sign(made, F.lit(SEED), F.lit("key-1"), F.lit("t")).alias("d"))
    block = "struct<type:string,canonicalization:string,created:string,verificationMethod:string,proofPurpose:string,proofValue:string>"
    read = signed_doc.select("d", F.from_json("d", f"`vk:signature` {block}")["vk:signature"].alias("s"))
    assert read.select(manifests.signature_valid(F.col("d"), F.col("s"), F.lit(PK)).alias("v")).first().v


def test_ephemeral_authorities_are_their_own(spark):
    got = publish.ephemeral(spark.range(3)).select("authority", "public_key", "seed").collect()
    assert len({r.authority for r in got}) == 3 and all(crypto.ed25519_public(bytes(r.seed)) == bytes(r.public_key) for r in got)


def test_opaque_deltas(spark):
    share = bytes.fromhex(wrapped(spark, b"c" * 32, resolve.CONTENT_LABEL))
    sealed_delta = publish.seal_delta(F.lit("sha256:x"), F.lit('[{"op":"remove","path":"/a"}]'), F.lit(b"c" * 32), F.lit(NONCE))

    def opened(delta, share, secret):
        public = F.lit(agreement_public(SENDER))
        return tuple(spark.range(1).select(publish.open_delta(delta, F.lit(share), F.lit(secret), public, F.lit(NONCE), F.lit("me")).alias("x")).first().x)

    assert opened(sealed_delta, share, READER) == ("sha256:x", '[{"op":"remove","path":"/a"}]', None)
    assert opened(sealed_delta, share, OTHER) == (None, None, "decryption failed")
    assert opened(sealed_delta, None, READER) == (None, None, "not a recipient")
    assert opened(crypto.seal(F.lit(b"c" * 32), F.lit(NONCE), F.lit('{"operations":[]}')), share, READER)[2] == "appliesTo missing"


# --- solutions with unbound variables ------------------------------------------------------------


def solutions(spark, names, rows):
    def term(x):
        return None if x is None else ("uri", x, None, None)

    made = spark.createDataFrame([tuple(map(term, r)) for r in rows], ", ".join(f"{n} {terms.TERM}" for n in names))
    return patterns.mark_unbound(made, *[n for k, n in enumerate(names) if any(r[k] is None for r in rows)])


def told(df):
    return sorted(tuple("" if x is None else x.value for x in r) for r in df.select(*sorted(df.columns)).collect())


def compatible(a, b):
    return all(a.get(k) is None or b.get(k) is None or a[k] == b[k] for k in {*a} & {*b})


def test_unbound_variables_by_brute_force(spark):
    rng = random.Random(4)
    pick = lambda n, k: [tuple(rng.choice([None, "1", "2"]) for _ in range(k)) for _ in range(n)]
    names_a, names_b = ("x", "y", "z"), ("w", "x", "y")
    a, b = pick(9, 3), pick(6, 3)
    da, db = solutions(spark, names_a, a), solutions(spark, names_b, b)
    ra, rb = [dict(zip(names_a, r)) for r in a], [dict(zip(names_b, r)) for r in b]

    def merged(p, q):
        return tuple((p.get(n) or q.get(n) or "") for n in ("w", "x", "y", "z"))

    both = [merged(p, q) for p in ra for q in rb if compatible(p, q)]
    assert told(patterns.join(da, db)) == sorted(both)
    alone = [merged(p, {}) for p in ra if not any(compatible(p, q) for q in rb)]
    assert told(patterns.optional(da, db)) == sorted(both + alone)
    flat = lambda p: tuple(p[n] or "" for n in names_a)
    assert told(patterns.exists(da, db)) == sorted(flat(p) for p in ra if any(compatible(p, q) for q in rb))
    assert told(patterns.not_exists(da, db)) == sorted(flat(p) for p in ra if not any(compatible(p, q) for q in rb))
    shares = lambda p, q: any(p.get(n) is not None and q.get(n) is not None for n in ("x", "y"))
    assert told(patterns.minus(da, db)) == sorted(flat(p) for p in ra if not any(compatible(p, q) and shares(p, q) for q in rb))


def test_no_join_of_everything_where_a_variable_is_shared(spark):
    a, b = solutions(spark, ("x", "y"), [("1", "2"), ("1", None)]), solutions(spark, ("x", "y"), [("1", "3"), ("2", None)])
    for made in (patterns.join(a, b), patterns.optional(a, b), patterns.minus(a, b), patterns.exists(a, b)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Cross" not in plan and "Join Inner\n" not in plan


def test_named_data_sets(spark):
    rows = [(None, "d", "uri", "p", "1", "literal", None, None, "x"), ("g", "a", "uri", "p", "1", "literal", None, None, "x"), ("h", "a", "uri", "p", "1", "literal", None, None, "y"), ("i", "b", "uri", "p", "1", "literal", None, None, "y")]
    table = spark.createDataFrame(rows, quads.SCHEMA)
    got = {(r.graph, r.s) for r in patterns.dataset(table, ["g", "h"], ["i"]).collect()}
    assert got == {(None, "a"), ("i", "b")} and patterns.dataset(table, ["g", "h"]).count() == 1 and patterns.dataset(table).count() == 4


def test_reached_is_the_closure_of_its_starts(spark):
    rng = random.Random(3)
    links = [(f"n{rng.randint(0, 30)}", f"n{rng.randint(0, 30)}") for _ in range(40)] + [("loop", "loop")]
    pairs, starts = solutions(spark, ("x", "y"), links), solutions(spark, ("x",), [("n1",), ("n5",), ("loop",), ("none",)])
    whole = [r for r in told(patterns.one_or_more(pairs)) if r[0] in ("n1", "n5", "loop")]
    assert told(patterns.reached(pairs, starts)) == whole


# --- folds along chains ----------------------------------------------------------------------------


def test_a_long_chain_of_which_every_version_is_asked(spark):
    n = 100_000
    name = lambda c: F.concat(F.lit("h"), c.cast("string"))
    k = F.col("id")
    nodes = spark.range(1, n + 1).select(
        name(k).alias("manifest_hash"), name(k - 1).alias("previous"), F.when(k == 70_000, "key").when(k == 20_000, "signature").alias("failure"),
        F.when(k % 1000 == 0, F.array(F.lit("old key"), F.lit(None))).when(k == 5, F.array(F.lit("delta"))).otherwise(F.array().cast("array<string>")).alias("marks"), "id",
    )
    got = chains.fold(nodes).withColumn("k", F.substring("manifest_hash", 2, 9).cast("long"))
    assert got.count() == n and got.where("depth <> k").count() == 0
    told = {r.k: r for r in got.where("k in (3, 999, 1000, 20000, 69999, 70000, 70001, 100000)").collect()}
    first = {k: None if r["first"] is None else tuple(r["first"]) for k, r in told.items()}
    assert first == {3: None, 999: None, 1000: None, 20000: (1, "signature"), 69999: (50_000, "signature"), 70000: (1, "key"), 70001: (2, "key"), 100_000: (30_001, "key")}
    assert [tuple(m) for m in told[100_000].marks] == [(1, "old key", 100), (99_996, "delta", 1)] and told[3].marks == [] and [tuple(m) for m in told[999].marks] == [(995, "delta", 1)]
    starts = spark.createDataFrame([("h500",), ("h500",), ("h3",), ("else",)], "manifest_hash string")
    assert chains.reach(starts, nodes).count() == 502  # h500 down to the missing h0, and what is in no store
    met = chains.passed(starts, nodes.withColumn("hit", k % 100 == 0), "hit")
    assert sorted(map(tuple, met.collect())) == [("h500", f"h{x}") for x in (100, 200, 300, 400, 500)]


def test_folds_of_circles_and_of_nothing(spark):
    schema = "manifest_hash string, previous string, failure string, marks array<string>"
    assert chains.fold(spark.createDataFrame([], schema)).count() == 0
    ring = spark.createDataFrame([("a", "b", None, None), ("b", "a", None, None)], schema)
    with pytest.raises(RuntimeError):
        chains.fold(ring, 4)
    with pytest.raises(RuntimeError):
        chains.passed(ring.select("manifest_hash"), ring.withColumn("hit", F.lit(True)), "hit")


# --- metadata hardening ----------------------------------------------------------------------------


def test_padding_is_undone_and_hides_sizes(spark):
    sizes = [0, 1, 7, 8, 500, 1015, 1016, 1017, 2040, 2041, 70_000]
    rows = spark.createDataFrame([(n, bytes([n % 256]) * n) for n in sizes] + [(-1, None), (-2, b"ends with zeros" + bytes(900))], "n int, plain binary")
    told = {r.n: r for r in rows.select("n", "plain", hardening.pad(F.col("plain")).alias("p"), hardening.unpad(hardening.pad(F.col("plain"))).alias("u"), hardening.padded_size(F.octet_length("plain")).alias("s")).collect()}
    assert all(r.u == r.plain for r in told.values()) and told[-1].p is None
    assert {n: len(told[n].p) for n in sizes} == {n: -(-(n + 8) // 1024) * 1024 for n in sizes} == {n: told[n].s for n in sizes}
    wrong = spark.createDataFrame([(b"",), (b"short",), (b"\xff" * 1024,), (bytes(7) + b"\x09" + bytes(8),), (bytes(7) + b"\x01" + b"ab" + bytes(6),)], "p binary")
    assert [r[0] for r in wrong.select(hardening.unpad(F.col("p"))).collect()] == [None] * 5


def test_statement_padding(spark):
    texts = ["", "a .", "a .\n", "".join(f"s{k} .\n" for k in range(8)), "".join(f"s{k} .\n" for k in range(9)), None]
    rows = spark.createDataFrame([(k, t, bytes([k]) * 32) for k, t in enumerate(texts)], "k int, t string, key binary")
    told = [r.p for r in rows.select("k", hardening.pad_statements(F.col("t"), F.col("key")).alias("p")).orderBy("k").collect()]
    assert [None if p is None else p.count("\n") for p in told] == [8, 8, 8, 8, 16, None]
    assert told[3] == texts[3] and told[4].startswith(texts[4]) and told[2].startswith("a .\n") and len({x for p in told[:5] for x in p.split("\n") if "padding" in x}) == 8 + 7 + 7 + 7
    assert all(quads.parse(spark.createDataFrame([("d", x) for x in told[0].splitlines()], "doc_id string, quad string")).select("p").distinct().collect()[0])


def test_decoys_look_like_recipients(spark):
    contents = spark.createDataFrame([(k, bytes([k]) * 32) for k in range(3)], "id int, hiding_key binary")
    readers = spark.createDataFrame([(0, "ann", bytes([1]) * 32), (0, "bob", bytes([2]) * 32), (1, "ann", bytes([1]) * 32), (9, "eve", bytes([3]) * 32)], "id int, recipient string, public_key binary")
    got = hardening.among_decoys(contents, readers).collect()
    assert sorted((r.id, r.real or "") for r in got) == sorted([(0, "ann"), (0, "bob"), (1, "ann")] + [(k, "") for k in range(3) for _ in range(2)])
    import uuid

    assert all(uuid.UUID(r.recipient).version == 4 and str(uuid.UUID(r.recipient)) == r.recipient and len(r.public_key) == 32 for r in got)
    assert len({r.recipient for r in got}) == len(got) and hardening.among_decoys(contents, readers, 0).count() == 3
