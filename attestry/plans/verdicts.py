"""Registered queries over signed stores: verdicts of resolution, privacy modes, deltas, keys and disclosure.

Each builds a store from a driver's table, with faults that follow from the row's key, so that SQL can
say what every verdict has to be. ``catalogue`` registers them with its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import crypto, hashing, jsondoc, temporal, terms, text
from attestry.operators import canonical, chains, hardening, keys, manifests, patterns, privacy, publish, quads, resolve
from attestry.operators.patterns import Literal, Var
from attestry.plans import durable
from attestry.plans.catalogue import BASE, C, O, graph, p, query, read
from attestry.sources import graphs, packages

STAMP = "2025-01-01T00:00:00Z"
POINT = (9).to_bytes(32, "little")  # the base point of key agreement


def row_key() -> Column:
    return F.col("k")


def digest(*parts: object) -> Column:
    """32 bytes that follow from the parts."""
    return F.unhex(F.sha2(F.concat_ws("|", *[x if isinstance(x, Column) else F.lit(str(x)) for x in parts]), 256))


def own_seed() -> Column:
    return digest("verdicts")


def other_seed() -> Column:
    return digest("another")


def suppliers(spark, d) -> DataFrame:
    """k, uri and key of each supplier, all under one authority."""
    authority = text.derive_authority(crypto.public_key(own_seed()))
    told = durable.spread(read(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), "k").select("k", authority.alias("authority"), crypto.public_key(own_seed()).alias("public_key"))
    return durable.cut(told.withColumn("uri", F.concat(F.lit("vk://"), "authority", F.lit("/data/"), row_key())))


def body_of(*parts: object) -> Column:
    return F.concat(F.lit('{"n":'), row_key(), F.lit(',"of":"'), *[x if isinstance(x, Column) else F.lit(str(x)) for x in parts], F.lit('"}'))


def sealed_by(doc: Column, seed: Column | None = None, **options) -> Column:
    return manifests.sign(doc, own_seed() if seed is None else seed, F.lit("key-1"), F.lit(STAMP), **options)


def plain(content: Column, version: int = 1, chain: Column | None = None, privacy_record: Column | None = None, addressing: str = "raw-sha256", **more: Column) -> Column:
    return manifests.build(F.col("uri"), F.lit(version), F.lit("main"), F.lit(STAMP), manifests.content_record(content, "application/json", addressing=addressing), chain, privacy=privacy_record, **more)


def link(previous: Column, genesis: Column, depth: int) -> Column:
    return F.struct(previous.alias("previous"), F.lit("main").alias("previousBranch"), genesis.alias("genesisHash"), F.lit(depth).cast("long").alias("depth"))


def blobs_of(*parts: tuple[DataFrame, Column]) -> DataFrame:
    """hash, bytes of texts or bytes, each under its own address."""
    out = None
    for rows, data in parts:
        told = rows.select(hashing.sha256(data).alias("hash"), data.cast("binary").alias("bytes")).where("bytes is not null")
        out = told if out is None else out.unionByName(told)
    return durable.cut(out.dropDuplicates(["hash"]))


# --- resolution ----------------------------------------------------------------------------------

_CODES = ["", "PARSE_ERROR", "AUTHORITY_NOT_FOUND", "MANIFEST_NOT_FOUND", "STORAGE_CORRUPTION", "MANIFEST_MALFORMED", "IDENTITY_MISMATCH", "SIGNATURE_VERIFICATION_FAILED", "CHAIN_VERIFICATION_FAILED", "CONTENT_NOT_FOUND", "STORAGE_CORRUPTION"]


@query(f"SELECT s_suppkey AS k, s_suppkey % 11 = 0 AS ok, nullif(list_extract({_CODES!r}, s_suppkey::INTEGER % 11 + 1), '') AS error_code FROM supplier")
def resolve_codes(spark, d):
    """One manifest for each supplier, every eleventh sound and the others with one fault each."""
    case = row_key() % 11
    rows = suppliers(spark, d).withColumn("content", jsondoc.canonical_json(body_of("codes")))
    first = durable.cut(rows.withColumn("doc", sealed_by(plain(F.col("content")))).withColumn("h", hashing.sha256(F.col("doc"))))
    later = first.where(case == 8).withColumn("second", sealed_by(plain(F.col("content"), 2, link(F.col("h"), F.col("h"), 7))))
    forged = first.where(case == 7).withColumn("second", sealed_by(plain(F.col("content")), other_seed()))
    moved = first.where(case == 6).withColumn("uri", F.concat("uri", F.lit("-moved"))).withColumn("second", sealed_by(plain(F.col("content")))).withColumn("uri", F.regexp_replace("uri", "-moved$", ""))
    made = durable.cut(first.where(~case.isin(6, 7, 8)).withColumn("second", F.col("doc")).unionByName(later).unionByName(forged).unionByName(moved))
    held = blobs_of((made, F.col("doc")), (made, F.col("second")), (made.where(case != 9), F.when(case != 10, F.col("content"))), (made, F.lit("no manifest")))
    spoiled = made.where(case == 4).select(F.concat(F.lit("sha256:spoiled"), row_key()).alias("hash"), F.col("second").cast("binary").alias("bytes"))
    spoiled = spoiled.unionByName(made.where(case == 10).select(hashing.sha256(F.col("content")).alias("hash"), F.lit("altered").cast("binary").alias("bytes")))
    wrong = F.when(case == 3, F.concat(F.lit("sha256:none"), row_key())).when(case == 4, F.concat(F.lit("sha256:spoiled"), row_key())).when(case == 5, hashing.sha256(F.lit("no manifest"))).otherwise(hashing.sha256(F.col("second")))
    asked = made.select("k", F.when(case == 1, F.concat(F.lit("no address "), row_key())).otherwise(F.col("uri")).alias("uri"), wrong.alias("manifest_hash"), F.when(case == 2, crypto.public_key(other_seed())).otherwise(F.col("public_key")).alias("public_key"))
    told = resolve.resolve(asked.drop("k"), held.unionByName(spoiled))
    return told.join(asked, ["uri", "manifest_hash"]).select("k", "ok", "error_code")


_KEYS = ["KEY_UNKNOWN", "", "", "KEY_EXPIRED", "KEY_REVOKED", ""]


@query(f"SELECT s_suppkey AS k, nullif(list_extract({_KEYS!r}, s_suppkey::INTEGER % 6 + 1), '') AS error_code, s_suppkey % 6 IN (2, 5) AS warned FROM supplier")
def resolve_key_life(spark, d):
    """Manifests whose key document knows the key as active, rotated, expired, revoked before or after, or not at all."""
    case = row_key() % 6
    rows = suppliers(spark, d).drop("authority", "public_key").withColumn("seed", digest("life", row_key()))
    rows = rows.withColumn("public_key", crypto.public_key(F.col("seed"))).withColumn("authority", text.derive_authority(F.col("public_key")))
    rows = rows.withColumn("uri", F.concat(F.lit("vk://"), "authority", F.lit("/data/"), row_key())).withColumn("content", jsondoc.canonical_json(body_of("life")))
    made = durable.cut(rows.withColumn("doc", manifests.sign(plain(F.col("content")), F.col("seed"), F.lit("key-1"), F.lit(STAMP))))
    day = lambda s: F.lit(s).cast("timestamp")
    entry = F.struct(F.lit("vk://a#key-1").alias("id"), F.col("public_key"), day("2025-02-01").alias("rotated_at"), F.when(case == 2, day("2025-12-31")).otherwise(day("2025-02-15")).alias("verify_until"), F.when(case == 4, day("2024-12-01")).otherwise(day("2025-06-01")).alias("invalid_after"))
    one = lambda *cases: F.when(case.isin(*cases), F.array(entry)).otherwise(F.array().cast("array<struct<id:string,public_key:binary,rotated_at:timestamp,verify_until:timestamp,invalid_after:timestamp>>"))
    documents = made.select("authority", one(1).alias("active"), one(2, 3).alias("rotated"), one(4, 5).alias("revoked"), F.struct(F.lit("P365D").alias("grace")).alias("policies"))
    asked = made.select("k", "uri", hashing.sha256(F.col("doc")).alias("manifest_hash"), "public_key")
    told = resolve.resolve(asked.drop("k"), blobs_of((made, F.col("doc")), (made, F.col("content"))), documents, day("2025-07-01"))
    return told.join(asked, ["uri", "manifest_hash"]).select("k", "error_code", (F.size("warnings") > 0).alias("warned"))


@query("""SELECT s_suppkey AS k, s_suppkey % 4 IN (0, 3) AS chain_ok, CASE s_suppkey % 4 WHEN 1 THEN 'privacy mode rises: public to encrypted' WHEN 2 THEN 'addressing changes' END AS reason,
  CASE WHEN s_suppkey % 4 = 2 THEN 0 WHEN s_suppkey % 4 = 1 THEN 1 WHEN s_suppkey % 4 = 0 THEN 2 ELSE 0 END::BIGINT AS changes FROM supplier""")
def private_chain_walk(spark, d):
    """Chains of three manifests whose modes fall or rise, whose addressing changes, or where all stays."""
    case = row_key() % 4
    rows = suppliers(spark, d).withColumn("content", jsondoc.canonical_json(body_of("walk")))
    modes = [F.when(case == 0, "proof-of-possession").otherwise("public"), F.when(case == 0, "encrypted").otherwise("public"), F.when(case == 1, "encrypted").otherwise("public")]
    record = [F.struct(m.alias("mode")) for m in modes]
    one = durable.cut(rows.withColumn("d1", sealed_by(plain(F.col("content"), 1, None, record[0]))).withColumn("h1", hashing.sha256(F.col("d1"))))
    two = durable.cut(one.withColumn("d2", sealed_by(plain(F.col("content"), 2, link(F.col("h1"), F.col("h1"), 2), record[1]))).withColumn("h2", hashing.sha256(F.col("d2"))))
    usual, other = (plain(F.col("content"), 3, link(F.col("h2"), F.col("h1"), 3), record[2], a) for a in ("raw-sha256", "cidv1-dag-cbor"))
    three = durable.cut(two.withColumn("d3", sealed_by(F.when(case == 2, other).otherwise(usual))).withColumn("h3", hashing.sha256(F.col("d3"))))
    judged = durable.cut(resolve.signed(manifests.read(blobs_of(*[(three, F.col(c)) for c in ("d1", "d2", "d3")]))))
    heads = three.select("k", F.col("h3").alias("manifest_hash"))
    told = resolve.chain_reports(heads, judged, blobs_of((three, F.col("content"))), True)
    changes = resolve.mode_changes(heads, judged).groupBy("head").agg(F.count("*").alias("changes"))
    return heads.join(told.join(changes, "head", "left"), F.col("manifest_hash") == F.col("head")).select("k", "chain_ok", "reason", F.coalesce("changes", F.lit(0)).cast("long").alias("changes"))


@query("""SELECT s_suppkey AS k, s_suppkey % 6 IN (0, 1, 3) AS chain_ok, 3::BIGINT AS depth, CASE s_suppkey % 6 WHEN 2 THEN 'key' WHEN 4 THEN 'key' WHEN 5 THEN 'signature' END AS reason,
  CASE s_suppkey % 6 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END::BIGINT AS warned FROM supplier""")
def chain_key_life(spark, d):
    """Chains of three under key documents: earlier versions by a key that is active, rotated in and out of grace, revoked after and before, or by no key that is known to the document."""
    case = row_key() % 6
    rows = suppliers(spark, d).drop("authority", "public_key").withColumns({"seed": digest("life", row_key()), "old_seed": digest("old", row_key())})
    rows = durable.cut(rows.withColumns({"public_key": crypto.public_key(F.col("seed")), "old_key": crypto.public_key(F.col("old_seed"))}).withColumn("authority", text.derive_authority(F.col("public_key"))))
    rows = rows.withColumn("uri", F.concat(F.lit("vk://"), "authority", F.lit("/data/"), row_key())).withColumn("content", jsondoc.canonical_json(body_of("life chain")))

    def signed_by_old(doc: Column, old: Column) -> Column:
        forged = F.when(case == 5, other_seed()).otherwise(F.col("seed"))
        return manifests.sign(doc, F.when(old, F.col("old_seed")).otherwise(forged), F.when(old, F.lit("key-0")).otherwise(F.lit("key-1")), F.lit(STAMP))

    one = durable.cut(rows.withColumn("d1", signed_by_old(plain(F.col("content")), case.isin(1, 2, 3, 4))).withColumn("h1", hashing.sha256(F.col("d1"))))
    two = durable.cut(one.withColumn("d2", signed_by_old(plain(F.col("content"), 2, link(F.col("h1"), F.col("h1"), 2)), case.isin(1, 2))).withColumn("h2", hashing.sha256(F.col("d2"))))
    three = durable.cut(two.withColumn("d3", manifests.sign(plain(F.col("content"), 3, link(F.col("h2"), F.col("h1"), 3)), F.col("seed"), F.lit("key-1"), F.lit(STAMP))).withColumn("h3", hashing.sha256(F.col("d3"))))
    day = lambda s: F.lit(s).cast("timestamp")
    none = F.array().cast("array<struct<id:string,public_key:binary,rotated_at:timestamp,verify_until:timestamp,invalid_after:timestamp>>")
    new, old = (
        F.struct(F.lit(f"vk://a#key-{n}").alias("id"), F.col(key).alias("public_key"), day("2025-02-01").alias("rotated_at"), F.when(case == 1, day("2025-12-31")).otherwise(day("2025-02-15")).alias("verify_until"), F.when(case == 4, day("2024-12-01")).otherwise(day("2025-06-01")).alias("invalid_after"))
        for n, key in ((1, "public_key"), (0, "old_key"))
    )
    documents = three.select("authority", F.array(new).alias("active"), F.when(case.isin(1, 2), F.array(old)).otherwise(none).alias("rotated"), F.when(case.isin(3, 4), F.array(old)).otherwise(none).alias("revoked"), F.struct(F.lit("P365D").alias("grace")).alias("policies"))
    judged = durable.cut(resolve.signed(manifests.read(blobs_of(*[(three, F.col(c)) for c in ("d1", "d2", "d3")])), keys.flatten(documents), day("2025-07-01")))
    told = resolve.chain_reports(three.select(F.col("h3").alias("manifest_hash")), judged, blobs_of((three, F.col("content"))))
    warned = chains.fold(judged.select("manifest_hash", F.col("chain.previous").alias("previous"), F.lit(None).cast("string").alias("failure"), F.array("key.warning").alias("marks")))
    warned = warned.select(F.col("manifest_hash").alias("head"), F.aggregate("marks", F.lit(0).cast("long"), lambda n, m: n + m["n"]).alias("warned"))
    return three.select("k", F.col("h3").alias("head")).join(told, "head").join(warned, "head").select("k", "chain_ok", "depth", "reason", "warned")


# --- privacy modes -------------------------------------------------------------------------------

_PRIVATE = """
SELECT s_suppkey AS k, s_suppkey % 10 <> 1 AS verified,
  list_extract(['public', 'public', 'proof-of-possession', 'encrypted', 'encrypted', 'selective-disclosure', 'selective-disclosure', 'anonymous', 'wax', 'attestation'], s_suppkey::INTEGER % 10 + 1) AS mode,
  list_extract(['verified', 'verified', 'private-custody-asserted', 'decrypted-verified', 'decryption-failed', 'partial-disclosure', 'partial-disclosure', 'verified', 'unsupported-mode', 'attestation-verified'], s_suppkey::INTEGER % 10 + 1) AS status,
  CASE WHEN s_suppkey % 10 = 7 THEN 'anonymous-ephemeral' END AS identity, CASE WHEN s_suppkey % 10 = 9 THEN CASE WHEN s_suppkey % 20 = 9 THEN 'full' ELSE 'partial' END END AS trust,
  CASE WHEN s_suppkey % 10 IN (1, 2, 4, 6, 8) OR s_suppkey % 20 = 19 THEN 1 ELSE 0 END AS warnings FROM supplier"""


@query(_PRIVATE)
def private_modes(spark, d):
    """A manifest of each mode for the suppliers: sound ones, altered content, stale custody, wrong secrets, wrong tags, lost subjects."""
    case = row_key() % 10
    rows = suppliers(spark, d).withColumns({"content": jsondoc.canonical_json(body_of("modes")), "id": row_key(), "nonce": F.substring(digest("nonce", row_key()), 1, 12), "sender": digest("sender", row_key()), "reader": digest("reader", row_key())})
    rows = durable.cut(rows)
    readers = rows.select("id", F.lit("me").alias("recipient"), crypto.shared_secret(F.col("reader"), F.lit(POINT)).alias("public_key"))
    made = []

    def add(docs: DataFrame, doc: Column, content: Column | None, canonical_text: Column | None = None) -> None:
        none = F.lit(None)
        made.append(docs.select("k", "uri", "public_key", "reader", doc.alias("doc"), (none if content is None else content).cast("binary").alias("body"), (none if canonical_text is None else canonical_text).cast("string").alias("canonical")))

    content = F.col("content")
    add(rows.where(case.isin(0, 1)), sealed_by(plain(content)), F.when(case == 0, content))
    custody = F.struct(F.lit("proof-of-possession").alias("mode"), F.struct(F.lit("P30D").alias("refreshPolicy")).alias("parameters"))
    add(rows.where(case == 2), sealed_by(plain(content, privacy_record=custody)), None)
    box = publish.encrypt(rows.where(case.isin(3, 4)).select("id", content.cast("binary").alias("plain"), digest("key", row_key()).alias("key"), "nonce", "sender"), readers)
    shut = rows.join(box, "id")
    add(shut, sealed_by(publish.build_encrypted(F.col("uri"), F.lit(1), F.lit(STAMP), F.lit("application/json"))), F.col("ciphertext"))
    salt, index_key = digest("salt", row_key()), digest("tags", row_key())
    said = [F.concat(F.lit(f"<{BASE}supplier/"), row_key(), F.lit(f'> <{BASE}told> "{i}" .')) for i in range(3)]
    hashes = [hashing.salted(salt, s) for s in said]
    tags = [text.to_hex(crypto.hmac_of(index_key, F.concat(salt, F.when(case == 6, F.lit("other")).otherwise(s).cast("binary")))) for s in said]
    blob = F.to_json(F.struct(F.array(said[0]).alias("mandatoryNQuads"), F.array(*map(text.to_hex, hashes)).alias("statementIndex"), F.array(*tags).alias("hmacTags")))
    shared = publish.share_index_key(rows.where(case.isin(5, 6)).select("id", index_key.alias("hmac_key"), "nonce", "sender"), readers.withColumn("statements", F.lit(None).cast("array<int>")))
    told = durable.cut(rows.join(shared, "id").withColumns({"blob": blob, "root": F.sha2(F.concat(*hashes), 256)}))
    form = F.concat(F.lit("<"), F.col("uri"), F.lit(f"> <{BASE}root> \""), F.col("root"), F.lit('" .\n'))
    shown = publish.build_disclosure(F.col("uri"), F.lit(1), F.lit(STAMP), F.col("blob"), F.lit(3), salt, F.col("root"), F.array(F.lit(0)))
    add(told, sealed_by(shown, profile="URDNA2015", canonical=form), F.col("blob"), form)
    hidden = manifests.anonymous_record(F.lit("ephemeral"), F.lit("public"), F.lit(False))
    add(rows.where(case == 7), sealed_by(plain(content, privacy_record=hidden)), content)
    add(rows.where(case == 8), sealed_by(plain(content, privacy_record=F.struct(F.lit("wax").alias("mode")))), content)
    about = durable.cut(rows.where(case == 9).withColumn("about", sealed_by(plain(content))))
    subject = F.struct(F.substring_index("uri", "/data", 1).alias("authority"), hashing.sha256(F.col("about")).alias("manifestHash"))
    claim = F.struct(F.lit("good").alias("property"), F.lit(True).alias("value"), F.lit("2030-01-01T00:00:00Z").alias("validUntil"))
    authority = F.regexp_extract("uri", "^vk://([^/]+)/", 1)
    add(about, sealed_by(publish.build_attestation(authority, row_key().cast("string"), F.lit(1), F.lit(STAMP), subject, claim, F.struct(F.lit("seen").alias("method")))), None)
    every = made[0]
    for m in made[1:]:
        every = every.unionByName(m)
    every = durable.cut(every.withColumn("manifest_hash", hashing.sha256(F.col("doc"))))
    held = blobs_of((every, F.col("doc")), (every, F.col("body")), (about.where(row_key() % 20 == 9), F.col("about")))
    asked = every.select("uri", "manifest_hash", "public_key", F.lit("me").alias("recipient"), F.when(case == 4, digest("wrong")).otherwise(F.col("reader")).alias("secret"))
    forms = every.where("canonical is not null").select("manifest_hash", "canonical")
    got = resolve.resolve_private(asked, held, None, F.lit("2025-03-01").cast("timestamp"), forms)
    return got.join(every.select("k", "manifest_hash"), "manifest_hash").select(
        "k", "verified", F.col("privacy_mode").alias("mode"), F.col("content_status").alias("status"), F.col("identity_type").alias("identity"), "trust", F.size("warnings").alias("warnings")
    )


@query("SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'sha256:' || s_suppkey END AS applies_to, CASE s_suppkey % 3 WHEN 1 THEN 'decryption failed' WHEN 2 THEN 'not a recipient' END AS error FROM supplier")
def opaque_deltas(spark, d):
    """Sealed deltas opened by their recipient, with a wrong secret, and by one who is no recipient."""
    case = row_key() % 3
    nonce, key, sender, reader = F.substring(digest("n", row_key()), 1, 12), digest("c", row_key()), digest("s", row_key()), digest("r", row_key())
    wrapped = crypto.wrap(key, sender, crypto.shared_secret(reader, F.lit(POINT)), nonce, resolve.CONTENT_LABEL, F.lit("me"))
    sealed = publish.seal_delta(F.concat(F.lit("sha256:"), row_key()), F.lit('[{"op":"remove","path":"/n"}]'), key, nonce)
    told = durable.cut(suppliers(spark, d).select("k", sealed.alias("sealed"), F.when(case != 2, wrapped).alias("share"), F.when(case == 1, digest("x")).otherwise(reader).alias("secret"), crypto.shared_secret(sender, F.lit(POINT)).alias("sent"), nonce.alias("nonce")))
    got = publish.open_delta(F.col("sealed"), F.col("share"), F.col("secret"), F.col("sent"), F.col("nonce"), F.lit("me"))
    return told.select("k", got.alias("x")).select("k", "x.applies_to", "x.error")


# --- deltas, keys and their documents ------------------------------------------------------------


@query("SELECT p_partkey AS k, list_extract(['valid', 'warning', 'invalid'], p_partkey::INTEGER % 3 + 1) AS verdict FROM part")
def delta_kinds(spark, d):
    """Patches of JSON and of graphs for each part: right ones, wrong ones with sound content, wrong ones without."""
    case, graph_ = row_key() % 3, row_key() % 2 == 1
    rows = durable.spread(read(spark, d, "part").select(F.col("p_partkey").alias("k")), "k")
    line = lambda n: F.concat(F.lit(f"<{BASE}part/"), row_key(), F.lit(f'> <{BASE}n> "{n}" .\n'))
    own = lambda n: F.concat(F.lit('{"k":'), row_key(), F.lit(f',"n":{n}}}'))
    before, now = F.when(graph_, line(1)).otherwise(own(1)), F.when(graph_, line(2)).otherwise(own(2))
    part = lambda op, n: F.struct(F.lit(op).alias("op"), F.concat(F.lit(f"<{BASE}part/"), row_key(), F.lit(">")).alias("subject"), F.lit(f"<{BASE}n>").alias("predicate"), F.lit(f'"{n}"').alias("object"))
    good = F.when(graph_, F.to_json(F.array(part("remove", 1), part("add", 2)))).otherwise(F.lit('[{"op":"replace","path":"/n","value":2}]'))
    bad = F.when(graph_, F.to_json(F.array(part("add", 3)))).otherwise(F.lit('[{"op":"replace","path":"/n","value":3}]'))
    ops = jsondoc.canonical_json(F.when(case == 0, good).otherwise(bad))
    told = durable.cut(rows.select("k", before.alias("before"), now.alias("now"), ops.alias("ops")))
    record = lambda c: F.when(graph_, manifests.content_record(c, "application/n-quads", "URDNA2015")).otherwise(manifests.content_record(c, "application/json"))
    delta = F.when(graph_, manifests.delta_record(F.col("ops"), hashing.sha256(F.col("before")), "application/rdf-patch")).otherwise(manifests.delta_record(F.col("ops"), hashing.sha256(F.col("before"))))
    name = lambda n: F.concat(F.lit(f"m{n}-"), row_key())
    chain = F.struct(name(1).alias("previous"))
    first = told.select(name(1).alias("manifest_hash"), record(F.col("before")).alias("content"))
    second = told.select(name(2).alias("manifest_hash"), record(F.col("now")).alias("content"), chain.alias("chain"), delta.alias("delta"))
    made = second.unionByName(first, allowMissingColumns=True)
    spoiled = told.where(case == 2).select(hashing.sha256(F.col("now")).alias("hash"), F.lit("altered").cast("binary").alias("bytes"))
    held = blobs_of((told, F.col("before")), (told, F.col("ops")), (told.where(case != 2), F.col("now"))).unionByName(spoiled)
    return told.select("k", name(2).alias("manifest_hash")).join(resolve.delta_verdicts(made, held), "manifest_hash").select("k", F.col("delta_verdict").alias("verdict"))


@query("SELECT s_suppkey AS k, s_suppkey % 3 = 0 AS valid FROM supplier")
def rotation_proofs(spark, d):
    """Rotations that both keys signed, with another reason told, and with one proof only."""
    case, old, new = row_key() % 3, digest("old", row_key()), digest("new", row_key())
    claim = F.concat(F.lit('{"newKeyId":"key-2","oldKeyId":"key-1","reason":"scheduled","rotatedAt":"'), F.lit(STAMP), F.lit('"}'))
    proof = lambda purpose, seed: F.struct(F.lit(purpose).alias("purpose"), F.concat(F.lit("z"), text.to_base58(crypto.sign(claim, seed))).alias("proofValue"))
    both = F.array(proof("old-key-authorizes-rotation", old), proof("new-key-confirms-rotation", new))
    entry = F.struct(F.lit("key-1").alias("id"), F.lit("key-2").alias("rotated_to"), F.lit(STAMP).alias("rotated_at"), F.when(case == 1, "lost").otherwise("scheduled").alias("reason"), crypto.public_key(old).alias("public_key"), F.when(case == 2, F.slice(both, 1, 1)).otherwise(both).alias("proof"))
    told = durable.cut(suppliers(spark, d).select("k", entry.alias("r"), crypto.public_key(new).alias("new")))
    return told.select("k", manifests.rotation_valid(F.col("r"), F.col("new")).alias("valid"))


@query("SELECT s_suppkey AS k, s_suppkey % 4 <> 0 AS valid, 1 + (s_suppkey % 2)::INTEGER AS keys FROM supplier")
def key_documents_signed(spark, d):
    """A signed key document for each supplier, every fourth one altered afterwards."""
    key = lambda n: F.struct(F.lit(n).alias("@id"), text.to_hex(digest(n, row_key())).alias("publicKey"))
    active = F.when(row_key() % 2 == 1, F.array(key("key-1"), key("key-2"))).otherwise(F.array(key("key-1")))
    built = publish.key_document(F.col("authority"), F.lit(1), active, F.struct(F.lit("P30D").alias("gracePeriodAfterRotation")))
    told = durable.cut(suppliers(spark, d).select("k", "public_key", sealed_by(built).alias("doc")))
    told = told.withColumn("doc", F.when(row_key() % 4 == 0, F.replace("doc", F.lit("P30D"), F.lit("P99D"))).otherwise(F.col("doc")))
    block = "struct<canonicalization:string,proofValue:string>"
    read_ = F.from_json("doc", f"`vk:signature` {block}, `vk:activeKeys` array<struct<`@id`:string>>")
    told = told.withColumn("m", read_)
    return told.select("k", manifests.signature_valid(F.col("doc"), F.col("m")["vk:signature"], F.col("public_key")).alias("valid"), F.size(F.col("m")["vk:activeKeys"]).alias("keys"))


@query("SELECT count(*) AS authorities, count(*) AS apart, true AS named FROM supplier")
def ephemeral_authorities(spark, d):
    """An authority of its own for each supplier: none is another's, and each names its key."""
    told = durable.cut(publish.ephemeral(read(spark, d, "supplier").select("s_suppkey")))
    return told.agg(F.count("*").alias("authorities"), F.count_distinct("authority").alias("apart"), F.every(text.public_key_of(F.col("authority")) == F.col("public_key")).alias("named"))


@query("SELECT doc_id, 'sha256:' || sha256('[{\"op\":\"add\",\"path\":\"/t\",\"value\":' || doc_id || '}]') AS delta_hash, 1::BIGINT AS operations, 'sha256:' || sha256(coalesce(text, '')) AS applies_to FROM documents")
def json_delta_records(spark, d):
    """The record of a patch on each document."""
    ops = F.concat(F.lit('[ {"value": '), "doc_id", F.lit(', "op": "add", "path": "/t"} ]'))
    record = manifests.delta_record(ops, hashing.sha256(F.coalesce("text", F.lit(""))))
    return read(spark, d, "documents").select("doc_id", record.alias("r")).select("doc_id", F.col("r.hash").alias("delta_hash"), "r.operations", F.col("r.appliesTo").alias("applies_to"))


@query("SELECT s_suppkey AS k, 'anonymous' AS mode, CASE WHEN s_suppkey % 2 = 0 THEN 'ephemeral' ELSE 'pseudonymous' END AS identity, CASE WHEN s_suppkey % 2 = 0 THEN 'an ephemeral authority refers to a key document' END AS reason FROM supplier")
def anonymous_records(spark, d):
    """The privacy record of anonymous manifests, and why a lasting key does not go with an ephemeral authority."""
    identity = F.when(row_key() % 2 == 0, "ephemeral").otherwise("pseudonymous")
    record = F.to_json(manifests.anonymous_record(identity, F.lit("public"), F.lit(False)))
    told = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).select("k", F.from_json(record, "mode string, parameters struct<authorityType:string>").alias("r"))
    return told.select("k", "r.mode", F.col("r.parameters.authorityType").alias("identity"), privacy.anonymous_reason(F.col("r.parameters.authorityType"), F.lit("vk://a/key/main#key-1")).alias("reason"))


# --- texts and addresses -------------------------------------------------------------------------


@query("SELECT event_id, event_id || '/a~b' || user_id AS path, 3::INTEGER AS segments FROM events")
def json_pointer_segments(spark, d):
    """Pointers with escaped characters, taken apart and put together again."""
    e = read(spark, d, "events")
    pointer = F.concat(F.lit("/"), "event_id", F.lit("~1a~0b"), F.lit("/"), "user_id", F.lit("/"))
    parts = jsondoc.pointer_segments(pointer)
    return e.select("event_id", F.concat(parts[0], parts[1]).alias("path"), F.size(parts).alias("segments"))


@query("SELECT doc_id, 'store/sha256-' || sha256(coalesce(text, '')) AS file FROM documents")
def file_names(spark, d):
    return read(spark, d, "documents").select("doc_id", packages.file_name("store", hashing.sha256(F.coalesce("text", F.lit("")))).alias("file"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 'web:' || substr(url, 9) WHEN starts_with(url, 'http://') THEN 'old:' || substr(url, 8) ELSE url END AS short FROM pages")
def prefix_shorten(spark, d):
    return read(spark, d, "pages").select("page_id", text.shorten(F.col("url"), {"web": "https://", "old": "http://"}).alias("short"))


@query("SELECT event_id, sign(epoch_ms(ts) - epoch_ms(TIMESTAMP '2024-01-15 00:00:00'))::INTEGER AS side FROM events")
def stamp_order(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", temporal.compare_stamps(temporal.format_stamp(F.col("ts").cast("timestamp")), F.lit("2024-01-15T00:00:00Z")).alias("side"))


# --- statements and patterns ---------------------------------------------------------------------


@query("""SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'malformed statement' END AS error,
  CASE WHEN n_nationkey % 3 <> 0 THEN sha256('<urn:vk:nation/' || n_nationkey || '> <urn:vk:name> "' || n_name || chr(233) || ' \\"x\\"" .' || chr(10)) END AS digest FROM nation""")
def canonical_escapes(spark, d):
    """Names told with different escapes have one canonical text; a broken line is an error of its document."""
    n = read(spark, d, "nation")
    accent = F.when(F.col("n_nationkey") % 2 == 0, F.lit("\\u00e9")).otherwise(F.lit("é"))
    line = F.concat(F.lit(f"<{BASE}nation/"), "n_nationkey", F.lit(f'> <{BASE}name> "'), "n_name", accent, F.lit(' \\u0022x\\""'), F.when(F.col("n_nationkey") % 2 == 0, F.lit(f"^^<{terms.XSD}string>")).otherwise(""), F.lit(" ."))
    broken = F.when(F.col("n_nationkey") % 3 == 0, F.lit(f"<{BASE}x> <{BASE}y> .")).otherwise(F.lit("# nothing more"))
    told = canonical.canonicalise(quads.quad_set(n.select(F.col("n_nationkey").alias("doc_id"), F.concat_ws("\n", line, broken).alias("text")), "text", "doc_id"))
    return told.select(F.col("doc_id").alias("k"), "error", F.sha2("text", 256).alias("digest"))


def _two_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """Customers with their pending orders, if any, and the dear orders of customers."""
    g = graph(spark, d)
    a = patterns.optional(patterns.bgp(g, [(C, "a", p("Customer"))]), patterns.bgp(g, [(O, p("by"), C), (O, p("status"), Literal("P"))]))
    b = patterns.bgp(g, [(O, p("by"), C), (O, p("total"), Var("t"))])
    return a, b.where(terms.number(F.col("t")) > 200_000).select("c", "o")


_SIDES = """WITH a AS (SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'),
b AS (SELECT o_custkey AS c, o_orderkey AS o FROM orders WHERE o_totalprice > 200000) """
_FITS = "b.c = a.c AND (a.o IS NULL OR b.o = a.o)"
_SHOWN = "'urn:vk:customer/' || a.c AS c, 'urn:vk:order/' || {} AS o"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.col("c.value").alias("c"), F.col("o.value").alias("o"))


@query(_SIDES + f"SELECT {_SHOWN.format('a.o')} FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_FITS})")
def rdf_minus_unbound(spark, d):
    return _shown(patterns.minus(*_two_sides(spark, d)))


@query(_SIDES + f"SELECT {_SHOWN.format('a.o')} FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_FITS})")
def rdf_exists_unbound(spark, d):
    return _shown(patterns.exists(*_two_sides(spark, d)))


@query(_SIDES + f"SELECT {_SHOWN.format('b.o')} FROM a JOIN b ON {_FITS}")
def rdf_join_unbound(spark, d):
    return _shown(patterns.join(*_two_sides(spark, d)))


@query(_SIDES + f"SELECT {_SHOWN.format('coalesce(b.o, a.o)')} FROM a LEFT JOIN b ON {_FITS}")
def rdf_optional_optional(spark, d):
    return _shown(patterns.optional(*_two_sides(spark, d)))


@query("SELECT o_orderstatus AS status, count(*) AS n, CASE WHEN o_orderstatus = 'P' THEN 'named' ELSE 'default' END AS place FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY o_orderstatus")
def rdf_from(spark, d):
    """Orders told in a graph for each status; one graph is asked as the default graph and one by its name."""
    o = read(spark, d, "orders")
    table = quads.from_table(o, F.concat(F.lit(BASE + "order/"), F.col("o_orderkey")), "Order", {"status": F.col("o_orderstatus")}, {}, BASE)
    status = F.when(F.col("p") == p("status"), F.concat(F.lit(BASE + "graph/"), F.col("o")))
    told = patterns.dataset(table.where(F.col("p") == p("status")).withColumn("graph", status), [f"{BASE}graph/F"], [f"{BASE}graph/P"])
    default = patterns.pattern(told, O, p("status"), Var("s")).select("s", F.lit("default").alias("place"))
    named = patterns.pattern(told, O, p("status"), Var("s"), Var("g")).select("s", F.lit("named").alias("place"))
    return default.unionByName(named).groupBy(F.col("s.value").alias("status"), "place").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS k, md5(c_name) AS md5, sha1(c_name) AS sha1, sha256(c_name) AS sha256, 'urn:vk:named/' || c_name AS address, 'en' AS tag, 'urn:vk:kind' AS kind, true AS same, true AS blank,
  CASE WHEN c_acctbal > 0 THEN 'owed' ELSE c_name END AS said FROM customer""")
def rdf_constructors(spark, d):
    """Terms made from names: digests, addresses, literals with a language or a datatype, blank nodes, choices."""
    t = terms.literal(F.col("c_name"))
    return read(spark, d, "customer").select(
        F.col("c_custkey").alias("k"), *[terms.digest(n, t)["value"].alias(n) for n in ("md5", "sha1", "sha256")], terms.iri(t, BASE + "named/")["value"].alias("address"), terms.lang(terms.strlang(t, "en")).alias("tag"),
        terms.datatype(terms.strdt(t, BASE + "kind")).alias("kind"), terms.same_term(terms.bnode(t), terms.bnode(t)).alias("same"), (terms.is_blank(terms.bnode()) & terms.is_uri(terms.uuid()) & terms.is_literal(terms.struuid())).alias("blank"),
        terms.if_(F.col("c_acctbal") > 0, terms.literal("owed"), terms.coalesce(F.lit(None).cast(terms.TERM), t))["value"].alias("said"),
    )


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def multibase_roundtrip(spark, d):
    """Digests told in base 58 with its mark, and read again."""
    told = F.concat(F.lit("z"), text.to_base58(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))))
    return read(spark, d, "documents").select("doc_id", text.to_hex(text.multibase(told)).alias("digest"))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 + 1 > 2 THEN 'too many blank nodes' END AS error, n_nationkey % 4 + 1 <= 2 AS named FROM nation")
def canonical_limits(spark, d):
    """Graphs of one to four blank nodes under a limit of two."""
    n = read(spark, d, "nation")
    line = lambda i: F.concat(F.lit(f"_:b{i} <{BASE}n> "), F.lit(f'"{i}" .'))
    lines = F.slice(F.array(*[line(i) for i in range(4)]), F.lit(1), (F.col("n_nationkey") % 4 + 1).cast("int"))
    told = canonical.canonicalise(n.select(F.col("n_nationkey").alias("doc_id"), F.explode(lines).alias("quad")), most_nodes=2)
    return told.select(F.col("doc_id").alias("k"), "error", F.col("text").isNotNull().alias("named"))


@query("SELECT s_suppkey AS k, list_extract([2, 1, 3], s_suppkey::INTEGER % 3 + 1) AS entries FROM supplier")
def published_entries(spark, d):
    """What a package of each mode holds: manifest and content, the manifest alone, or an attestation with its subject and that one's content."""
    case = row_key() % 3
    rows = suppliers(spark, d).withColumn("content", jsondoc.canonical_json(body_of("published")))
    custody = F.struct(F.lit("proof-of-possession").alias("mode"))
    first = durable.cut(rows.withColumn("doc", F.when(case == 1, sealed_by(plain(F.col("content"), privacy_record=custody))).otherwise(sealed_by(plain(F.col("content"))))))
    subject = F.struct(F.substring_index("uri", "/data", 1).alias("authority"), hashing.sha256(F.col("doc")).alias("manifestHash"))
    claim = F.struct(F.lit("good").alias("property"), F.lit(True).alias("value"))
    about = sealed_by(publish.build_attestation(F.col("authority"), row_key().cast("string"), F.lit(1), F.lit(STAMP), subject, claim, F.struct(F.lit("seen").alias("method"))))
    made = durable.cut(first.withColumn("head", F.when(case == 2, about).otherwise(F.col("doc"))))
    held = blobs_of((made, F.col("doc")), (made, F.col("head")), (made.where(case != 1), F.col("content")))
    heads = made.select(row_key().cast("string").alias("uri"), hashing.sha256(F.col("head")).alias("manifest_hash"))
    return packages.published(heads, held).groupBy(F.col("uri").cast("long").alias("k")).agg(F.count("*").cast("int").alias("entries"))


@query("""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
SELECT doc_id, sha256(unhex('A3' || '65' || hex('@type'::BLOB) || '67' || hex('Content'::BLOB) || '6A' || hex('vk:content'::BLOB)
  || CASE WHEN n < 24 THEN printf('%02X', n + 64) WHEN n < 256 THEN '58' || printf('%02X', n) WHEN n < 65536 THEN '59' || printf('%04X', n) ELSE '5A' || printf('%08X', n) END
  || h || '73' || hex('vk:canonicalization'::BLOB) || '63' || hex('JCS'::BLOB))) AS digest FROM d""")
def cbor_envelope(spark, d):
    """The digest over each document's CBOR envelope, which its content identifier is made of."""
    wrapped = hashing.envelope(F.coalesce("text", F.lit("")).cast("binary"), "Content", "JCS", "vk")
    return read(spark, d, "documents").select("doc_id", F.sha2(wrapped, 256).alias("digest"))


@query("SELECT count(*) AS files, true AS intact, count(*) AS found FROM supplier")
def files_roundtrip(spark, d):
    """A file for each supplier under its address, in the folder that all executors share, read and looked for again."""
    rows = read(spark, d, "supplier").select(F.to_json(F.struct("*")).alias("body"))
    held = blobs_of((rows, F.col("body")))
    path = durable.fresh_path(spark, "files")
    packages.write_files(held, path)
    told = packages.scan_files(spark, path)
    found = told.join(held.select("hash"), "hash", "left_semi").agg(F.count("*").alias("found"))
    return told.agg(F.count("*").alias("files"), F.every(hashing.sha256(F.col("bytes")) == F.col("hash")).alias("intact")).crossJoin(found)


@query("SELECT n_nationkey AS k, n_name AS name, n_nationkey % 4 AS form FROM nation")
def graph_factory(spark, d):
    """Nations told as JSON-LD under a context from a registry, as N-Quads, Turtle and RDF/XML, each loaded by its media type."""
    n = read(spark, d, "nation")
    me, name = F.concat(F.lit(BASE + "nation/"), "n_nationkey"), F.col("n_name")
    forms = [
        ("application/ld+json", F.concat(F.lit('{"@context":"urn:c","@id":"'), me, F.lit('","name":"'), name, F.lit('"}'))),
        ("application/n-quads", F.concat(F.lit("<"), me, F.lit(f'> <{BASE}name> "'), name, F.lit('" .'))),
        ("text/turtle", F.concat(F.lit(f"@prefix v: <{BASE}> . <"), me, F.lit('> v:name "'), name, F.lit('" .'))),
        ("application/rdf+xml", F.concat(F.lit(f'<rdf:RDF xmlns:rdf="{graphs.RDF}" xmlns:v="{BASE}"><rdf:Description rdf:about="'), me, F.lit('"><v:name>'), name, F.lit("</v:name></rdf:Description></rdf:RDF>"))),
    ]
    out = None
    for k, (media, doc) in enumerate(forms):
        options = {"registry": {"urn:c": {"@context": {"@vocab": BASE}}}} if k == 0 else {}
        docs = n.where(F.col("n_nationkey") % 4 == k).select(F.col("n_nationkey").alias("doc_id"), doc.alias("text"))
        told = patterns.pattern(graphs.build_graph(docs, "doc_id", "text", media, **options), C, p("name"), Var("name"))
        told = told.select(F.substring_index("c.value", "/", -1).cast("int").alias("k"), F.col("name.value").alias("name"), F.lit(k).alias("form"))
        out = told if out is None else out.unionByName(told)
    return out


# --- metadata hardening ----------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS digest, (octet_length(encode(text)) + 8 + 1023) // 1024 * 1024 + 16 AS sealed_bytes FROM documents WHERE text IS NOT NULL")
def hardened_sizes(spark, d):
    """All documents padded to quanta of a kilobyte, sealed, opened and unpadded again."""
    key, nonce = digest("pad", F.col("doc_id")), F.substring(digest("nonce", F.col("doc_id")), 1, 12)
    docs = read(spark, d, "documents").where("text is not null").select("doc_id", crypto.seal(key, nonce, hardening.pad(F.col("text").cast("binary"))).alias("sealed"), key.alias("key"), nonce.alias("nonce"))
    plain = hardening.unpad(crypto.unseal(F.col("key"), F.col("nonce"), F.col("sealed")))
    return docs.select("doc_id", F.sha2(plain, 256).alias("digest"), F.octet_length("sealed").cast("long").alias("sealed_bytes"))


@query("""SELECT s_suppkey AS k, 3::BIGINT AS shares, 1::BIGINT AS forms, ((length('{"n":' || s_suppkey || ',"of":"hidden"}') + 8 + 1023) // 1024 * 1024 + 16)::BIGINT AS sealed_bytes, true AS opened, 'decrypted-verified' AS status FROM supplier""")
def hardened_recipients(spark, d):
    """Padded content for one reader among two decoys, under opaque names; the reader opens it by the name that the publisher tells."""
    rows = suppliers(spark, d).withColumns({"content": jsondoc.canonical_json(body_of("hidden")), "id": row_key(), "hiding_key": digest("hiding", row_key()), "key": digest("content key", row_key()), "nonce": F.substring(digest("nonce", row_key()), 1, 12), "sender": digest("sender", row_key()), "reader": digest("reader", row_key())})
    rows = durable.cut(rows)
    readers = rows.select("id", F.concat(F.lit("reader "), F.col("k").cast("string")).alias("recipient"), crypto.shared_secret(F.col("reader"), F.lit(POINT)).alias("public_key"))
    named = durable.cut(hardening.among_decoys(rows, readers))
    sealed = publish.encrypt(rows.select("id", F.col("content").cast("binary").alias("plain"), "key", "nonce", "sender"), named.drop("real"), quantum=hardening.QUANTUM)
    both = durable.cut(rows.join(sealed, "id"))
    made = durable.cut(both.withColumn("doc", manifests.sign(publish.build_encrypted(F.col("uri"), F.lit(1), F.lit(STAMP), F.lit("application/json")), own_seed(), F.lit("key-1"), F.lit(STAMP))))
    asked = made.join(named.where("real is not null").select("id", "recipient"), "id").select("uri", hashing.sha256(F.col("doc")).alias("manifest_hash"), "public_key", "recipient", F.col("reader").alias("secret"))
    got = resolve.resolve_private(asked, blobs_of((made, F.col("doc")), (made, F.col("ciphertext"))))
    shapes = F.transform("recipients", lambda r: F.concat(F.length(r["encryptedKey"]).cast("string"), F.regexp_replace(r["id"], "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$", "uuid")))
    told = made.select("k", "uri", "content", F.size("recipients").cast("long").alias("shares"), F.size(F.array_distinct(shapes)).cast("long").alias("forms"), F.octet_length("ciphertext").cast("long").alias("sealed_bytes"))
    return told.join(got.select("uri", F.col("content").alias("plain"), F.col("content_status").alias("status")), "uri").select("k", "shares", "forms", "sealed_bytes", (F.col("plain") == F.col("content").cast("binary")).alias("opened"), "status")


@query("SELECT s_suppkey AS k, ((1 + s_suppkey % 19 + 7) // 8 * 8)::BIGINT AS published, (1 + s_suppkey % 19)::BIGINT AS real, true AS holds FROM supplier")
def hardened_indexes(spark, d):
    """Statement indexes of one to nineteen statements, published in multiples of eight."""
    n = F.transform(F.sequence(F.lit(1), (F.col("s_suppkey") % 19 + 1).cast("int")), lambda i: F.concat(F.lit("<urn:s/"), F.col("s_suppkey").cast("string"), F.lit('> <urn:p> "'), i.cast("string"), F.lit('" .\n')))
    rows = read(spark, d, "supplier").select("s_suppkey", F.array_join(n, "").alias("text"))
    rows = durable.cut(rows.select("s_suppkey", "text", hardening.pad_statements(F.col("text"), digest("hiding", F.col("s_suppkey"))).alias("padded")))
    index = privacy.statement_index(rows, "s_suppkey", "padded", digest("salt"))
    real = hardening.real_statements(index).groupBy("doc_id").agg(F.count("*").alias("real"), F.max("idx").alias("last"))
    told = index.groupBy("doc_id").agg(F.count("*").alias("published"), F.count_distinct("hash").alias("different"))
    return told.join(real, "doc_id").select(F.col("doc_id").alias("k"), "published", "real", ((F.col("last") == F.col("real") - 1) & (F.col("different") == F.col("published"))).alias("holds"))
