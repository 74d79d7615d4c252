"""The registered queries over the driver's tables, each beside its SQL counterpart.

``QUERIES`` and ``SQL`` share keys; a key without SQL is an operator that SQL cannot express and that
the tests check against vectors or brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.functions import crypto, hashing, jsondoc, temporal, terms, text
from attestry.operators import blobs, canonical, chains, entailment, keys, manifests, patterns, privacy, quads, resolve
from attestry.operators.patterns import Literal, Var
from attestry.plans import durable
from attestry.sources import addressed, graphs, packages, statements, table_functions

BASE = "urn:vk:"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from attestry.plans import verdicts  # noqa: F401  registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


# --- blobs ---------------------------------------------------------------------------------------


@query("SELECT doc_id, 'sha256:' || sha256(text) AS address FROM documents")
def cas_address(spark, d):
    return read(spark, d, "documents").select("doc_id", hashing.sha256(F.col("text")).alias("address"))


@query("SELECT count(*) AS documents, count(DISTINCT text) AS blobs, sum(n)::BIGINT AS bytes FROM (SELECT text, CASE WHEN row_number() OVER (PARTITION BY text) = 1 THEN octet_length(encode(text)) ELSE 0 END AS n FROM documents)")
def cas_dedup(spark, d):
    docs = read(spark, d, "documents").select(hashing.sha256(F.col("text")).alias("hash"), F.octet_length("text").alias("n"))
    each = docs.groupBy("hash").agg(F.count("*").alias("c"), F.min("n").alias("n"))
    return each.agg(F.sum("c").alias("documents"), F.count("*").alias("blobs"), F.sum("n").alias("bytes"))


@query("SELECT doc_id, octet_length(encode(text)) AS n, 'sha256:' || sha256(text) LIKE 'sha256:0%' AS low FROM documents WHERE text IS NOT NULL")
def addressed_files(spark, d):
    """All documents as files named by their address, read back, and those of some prefixes by a filter that is pushed down."""
    addressed.register(spark)
    docs = read(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("bytes"), hashing.sha256(F.col("text")).alias("hash"))
    path = durable.fresh_path(spark, "addressed")
    docs.select("hash", "bytes").dropDuplicates(["hash"]).write.format("addressed").mode("append").save(path)
    found, again = (spark.read.format("addressed").load(path) for _ in range(2))
    low = again.where(F.startswith("hash", F.lit("sha256:0"))).select("hash", F.lit(True).alias("low"))
    told = docs.select("doc_id", "hash").join(found.select("hash", F.octet_length("bytes").cast("long").alias("n")), "hash").join(low, "hash", "left")
    return told.select("doc_id", "n", F.coalesce("low", F.lit(False)).alias("low"))


@query("SELECT doc_id FROM documents WHERE source = 'src1' AND text IN (SELECT text FROM documents WHERE source <> 'src1')")
def cas_semi(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", hashing.sha256(F.col("text")).alias("hash"))
    return blobs.present(docs.where("source = 'src1'"), docs.where("source <> 'src1'")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source = 'src1' AND text NOT IN (SELECT text FROM documents WHERE source <> 'src1' AND text IS NOT NULL)")
def cas_anti(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", hashing.sha256(F.col("text")).alias("hash"))
    return blobs.without(docs.where("source = 'src1'"), docs.where("source <> 'src1'")).select("doc_id")


@query("SELECT doc_id, found, CASE WHEN found THEN octet_length(encode(text))::INTEGER ELSE 0 END AS n FROM (SELECT *, text IN (SELECT text FROM documents WHERE doc_id % 3 <> 0 AND text IS NOT NULL) AS found FROM documents)")
def cas_lookup(spark, d):
    """All documents asked by their addresses of a store that lost every third one."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    lost = docs.where("doc_id % 3 = 0").join(docs.where("doc_id % 3 <> 0").select("text").distinct(), "text", "left_anti")
    kept = blobs.without(blobs.store(docs, F.col("text")), lost.select(hashing.sha256(F.col("text")).alias("hash")))
    told = blobs.lookup(docs.select("doc_id", hashing.sha256(F.col("text")).alias("hash")), kept)
    return told.select("doc_id", F.col("bytes").isNotNull().alias("found"), F.coalesce(F.octet_length("bytes"), F.lit(0)).alias("n"))


@query("SELECT count(*) AS blobs, count(*) FILTER (WHERE doc_id % 7 = 0) AS corrupted FROM documents")
def cas_corrupted(spark, d):
    """Flips a byte of every seventh document and finds just these by their addresses."""
    docs = read(spark, d, "documents").select("doc_id", hashing.sha256(F.col("text")).alias("hash"), F.col("text").cast("binary").alias("bytes"))
    bad = docs.withColumn("bytes", F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("bytes"), F.lit(b"!"))).otherwise(F.col("bytes")))
    return bad.agg(F.count("*").alias("blobs"), F.count_if(~hashing.verify(F.col("hash"), F.col("bytes"))).alias("corrupted"))


@query("SELECT text AS hash, count(DISTINCT text) = 1 AS identical, 2 * count(*) AS readings FROM (SELECT 'sha256:' || sha256(text) AS text FROM documents) GROUP BY text")
def adapter_identity(spark, d):
    docs = read(spark, d, "documents").select(hashing.sha256(F.col("text")).alias("hash"), F.col("text").cast("binary").alias("bytes"))
    return blobs.identical(docs.unionByName(docs))


# --- statements ----------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
h AS (SELECT doc_id, i, sha256('salt' || s) AS h FROM s WHERE s <> '')
SELECT doc_id, sha256(unhex(string_agg(h, '' ORDER BY i))) AS root, count(*) AS statements FROM h GROUP BY doc_id""")
def statement_index_root(spark, d):
    return privacy.index_root(privacy.statement_index(read(spark, d, "documents"), "doc_id", "text", F.lit(b"salt")))


@query("""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
t AS (SELECT doc_id, unnest(list_filter(l, lambda x: x <> '')) AS statement, generate_subscripts(list_filter(l, lambda x: x <> ''), 1) - 1 AS idx FROM s),
h AS (SELECT doc_id, idx::INTEGER AS idx, unhex(sha256(unhex('5D534F' || repeat('36', 61)) || encode(statement))) AS i FROM t)
SELECT doc_id, idx, sha256(unhex('373925' || repeat('5C', 61)) || i) AS tag FROM h""")
def hmac_tags(spark, d):
    """Tags under the key ``key``: the SQL has its padded blocks written out."""
    return privacy.tags(privacy.statement_index(read(spark, d, "documents"), "doc_id", "text", F.lit(b"")), b"key").select("doc_id", "idx", "tag")


@query("""
WITH s AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS s FROM documents), c AS (SELECT DISTINCT source, s FROM s WHERE s <> '')
SELECT doc_id, count(*) AS found FROM s JOIN c ON s.s = c.s AND c.source <> s.source GROUP BY doc_id""")
def dictionary_attack(spark, d):
    """Statements of every source guessed from the lines of each other one, through salted digests only."""
    docs = read(spark, d, "documents")
    index = privacy.statement_index(docs, "doc_id", "text", F.lit(b"pepper")).drop("statement").join(docs.select("doc_id", "source"), "doc_id")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("statement")).where("statement <> ''").distinct()
    told = privacy.guesses(index, lines, F.lit(b"pepper"))
    # a guess counts once for each other source that holds it
    holders = docs.select("source", F.explode(F.split("text", "\n")).alias("candidate")).where("candidate <> ''").groupBy("candidate").agg(F.collect_set("source").alias("holders"))
    rest = F.size(F.array_remove("holders", F.col("source")))
    return told.join(holders, "candidate").groupBy("doc_id").agg(F.sum(rest).cast("long").alias("found")).where("found > 0")


@query("""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents),
t AS (SELECT DISTINCT doc_id, trim(s) AS q FROM s WHERE trim(s) <> '' AND NOT starts_with(trim(s), '#'))
SELECT doc_id, sha256(string_agg(q, chr(10) ORDER BY q) || chr(10)) AS digest FROM t GROUP BY doc_id""")
def nquads_serialize(spark, d):
    told = quads.serialise(quads.quad_set(read(spark, d, "documents"), "text", "doc_id"))
    return told.select("doc_id", F.sha2("text", 256).alias("digest"))


def _events(spark, d):
    events = read(spark, d, "events")
    return events.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "purchase", "add").otherwise("remove").alias("op"), F.concat(F.lit("user "), F.col("user_id"), F.lit(" at "), F.dayofmonth("ts")).alias("quad"), "user_id")


_OPS = "SELECT event_id AS seq, CASE WHEN event_type IN ('signup', 'purchase') THEN 'add' ELSE 'remove' END AS op, 'user ' || user_id || ' at ' || day(ts) AS quad, user_id FROM events"


@query(f"""
WITH o AS ({_OPS}), l AS (SELECT quad, arg_max(op, seq) AS op FROM o GROUP BY quad),
g AS (SELECT DISTINCT 'user ' || user_id || ' at 1' AS quad FROM events)
SELECT quad FROM g WHERE quad NOT IN (SELECT quad FROM l) UNION SELECT quad FROM l WHERE op = 'add'""")
def quad_patch_apply(spark, d):
    ops = _events(spark, d)
    given = ops.select(F.concat(F.lit("user "), F.col("user_id"), F.lit(" at 1")).alias("quad"))
    return quads.apply_patch(given, ops)


@query("""
WITH a AS (SELECT DISTINCT user_id || ':' || event_type AS quad FROM events WHERE day(ts) <= 15),
b AS (SELECT DISTINCT user_id || ':' || event_type AS quad FROM events WHERE day(ts) > 15)
SELECT 'remove' AS op, quad FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'add', quad FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def quad_diff(spark, d):
    said = read(spark, d, "events").select(F.concat_ws(":", "user_id", "event_type").alias("quad"), F.dayofmonth("ts").alias("day"))
    return quads.difference(said.where("day <= 15"), said.where("day > 15"))


# --- chains --------------------------------------------------------------------------------------


def _manifests(spark, d):
    """A version chain for each conversation: a turn is a version, its address covers its content.

    Turn 3 of every third conversation is tampered with after the chain was made.
    """
    turns = read(spark, d, "conversations")
    own = F.concat_ws("|", F.lit("m"), "conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.select("conv_id", "turn", "role", hashing.sha256(own).alias("manifest_hash"))
    rows = rows.select("*", F.lag("manifest_hash").over(w).alias("p"), F.first("manifest_hash").over(w).alias("g"), F.row_number().over(w).alias("n"), F.lag("role").over(w).alias("b"))
    bad = (F.col("turn") == 3) & (F.col("conv_id") % 3 == 0)
    chain = F.struct(F.col("p").alias("previous"), F.col("b").alias("previous_branch"), F.col("g").alias("genesis_hash"), (F.col("n") + F.when(bad, 1).otherwise(0)).alias("depth"))
    return rows.select("manifest_hash", F.col("conv_id").alias("id"), F.col("n").cast("decimal(38,0)").alias("version_n"), F.col("role").alias("branch"), F.when(F.col("p").isNotNull(), chain).alias("chain"), "n")


_CHAIN = """
t AS (SELECT *, row_number() OVER w AS n, max(CASE WHEN turn = 3 AND conv_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn) AS bad,
        lag(CASE WHEN turn = 3 AND conv_id % 3 = 0 THEN 1 ELSE 0 END) OVER w AS was FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
v AS (SELECT conv_id, n, CASE WHEN n + bad <> (CASE WHEN n = 2 THEN 1 ELSE n - 1 + was END) + 1 THEN 'depth' END AS reason FROM t WHERE n > 1)"""


@query(f"WITH {_CHAIN} SELECT conv_id AS id, n, reason FROM v")
def chain_link_verdict(spark, d):
    made = _manifests(spark, d)
    return chains.link_verdicts(made).join(made.select("manifest_hash", "id", "n"), "manifest_hash").select("id", F.col("n").cast("long").alias("n"), "reason")


@query("SELECT conv_id AS id, count(*) AS depth FROM conversations GROUP BY conv_id")
def chain_walk_depth(spark, d):
    made = _manifests(spark, d)
    links = made.select("manifest_hash", F.col("chain.previous").alias("previous"), F.lit(None).cast("string").alias("failure"), F.lit(None).cast("array<string>").alias("marks"))
    return chains.heads(made).select("manifest_hash", "id").join(chains.fold(links), "manifest_hash").select("id", "depth")


@query(f"""WITH {_CHAIN}, m AS (SELECT conv_id, max(n) AS most FROM t GROUP BY conv_id)
SELECT conv_id AS id, bool_and(reason IS NULL) IS NOT FALSE AS valid, arg_max(reason, n) FILTER (WHERE reason IS NOT NULL) AS reason FROM m LEFT JOIN v USING (conv_id) GROUP BY conv_id""")
def chain_first_failure(spark, d):
    made = _manifests(spark, d)
    told = chains.report(made, chains.link_verdicts(made))
    return told.join(made.select(F.col("manifest_hash").alias("head"), "id"), "head").select("id", "valid", "reason")


@query("""
WITH RECURSIVE o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn, role, text FROM conversations),
f AS (SELECT conv_id, n, sha256('' || '|' || turn || '|' || role || '|' || text) AS h FROM o WHERE n = 1
      UNION ALL SELECT o.conv_id, o.n, sha256(f.h || '|' || o.turn || '|' || o.role || '|' || o.text) FROM f JOIN o ON o.conv_id = f.conv_id AND o.n = f.n + 1)
SELECT conv_id AS id, arg_max(h, n) AS head, max(n) AS depth FROM f GROUP BY conv_id""")
def chain_fold_head(spark, d):
    """The head's digest of a chain in which every version covers the one before it."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    told = read(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("r"))
    fold = F.aggregate("r", F.lit(""), lambda h, r: F.sha2(F.concat_ws("|", h, r["turn"], r["role"], r["text"]), 256))
    return told.select(F.col("conv_id").alias("id"), fold.alias("head"), F.size("r").cast("long").alias("depth"))


@query("SELECT conv_id AS id, max(turn) AS turn FROM conversations GROUP BY conv_id")
def head_selection(spark, d):
    turns = read(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").cast("decimal(38,0)").alias("version_n"), "turn", F.sha2("text", 256).alias("manifest_hash"))
    return chains.heads(turns).select("id", "turn")


@query("SELECT conv_id AS id, count(DISTINCT sha256(text)) <= 1 AS same, count(*) AS versions FROM conversations GROUP BY conv_id")
def same_plaintext(spark, d):
    return chains.same_plaintext(read(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.sha2("text", 256).alias("logical_hash")))


# --- keys and time -------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'active' WHEN o_orderstatus = 'F' THEN
  CASE WHEN TIMESTAMP '1998-06-01' <= least(o_orderdate + INTERVAL 180 DAY, TIMESTAMP '1998-12-01') THEN 'rotated-grace' ELSE 'rotated-expired' END
  ELSE 'revoked' END AS status,
  CASE WHEN o_orderstatus = 'P' THEN true WHEN o_orderstatus = 'F' THEN TIMESTAMP '1998-06-01' <= least(o_orderdate + INTERVAL 180 DAY, TIMESTAMP '1998-12-01')
  ELSE o_orderdate < TIMESTAMP '1997-01-01' END AS valid FROM orders""")
def key_grace_status(spark, d):
    orders = read(spark, d, "orders")
    found = F.when(F.col("o_orderstatus") == "P", "active").when(F.col("o_orderstatus") == "F", "rotated").otherwise("revoked")
    date = F.col("o_orderdate").cast("timestamp")
    end = keys.grace_end(date, F.lit("1998-12-01").cast("timestamp"), F.lit("P180D"))
    told = keys.status(found, date, F.lit("1998-06-01").cast("timestamp"), end, F.lit("1997-01-01").cast("timestamp"))
    return orders.select("o_orderkey", told["status"].alias("status"), told["valid"].alias("valid"))


@query("""
SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN CASE WHEN ts <= TIMESTAMP '2024-01-15 00:00:00' THEN 'rotated-grace' ELSE 'rotated-expired' END
  WHEN 2 THEN 'revoked' ELSE 'unknown' END AS status,
  CASE user_id % 4 WHEN 0 THEN true WHEN 1 THEN ts <= TIMESTAMP '2024-01-15 00:00:00' WHEN 2 THEN ts < TIMESTAMP '2024-01-10 00:00:00' ELSE false END AS valid FROM events""")
def key_interval_join(spark, d):
    """Events signed by one of four keys of one key document, judged at their own time."""
    one = "SELECT 'a' AS authority, array(named_struct('id', 'vk://a#key-0', 'public_key', x'00')) AS active, array(named_struct('id', 'vk://a#key-1', 'public_key', x'01', 'rotated_at', timestamp'2024-01-05', 'verify_until', timestamp'2024-02-20')) AS rotated, array(named_struct('id', 'vk://a#key-2', 'public_key', x'02', 'invalid_after', timestamp'2024-01-10')) AS revoked, named_struct('grace', 'P10D') AS policies"
    events = read(spark, d, "events").select("event_id", F.lit("a").alias("authority"), F.concat(F.lit("vk://a#key-"), F.col("user_id") % 4).alias("method"), F.col("ts").cast("timestamp").alias("created"))
    told = keys.statuses(events, keys.flatten(spark.sql(one)), F.col("created"))
    return told.select("event_id", "key.status", "key.valid")


@query("""
SELECT c_custkey, moment, CASE WHEN moment <= TIMESTAMP '2024-01-11' THEN 'rotated-grace' ELSE 'rotated-expired' END AS status
FROM customer, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-29', INTERVAL 7 DAY)) t(moment)""")
def key_status_sweep(spark, d):
    one = "SELECT 'a' AS authority, cast(array() AS array<struct<id:string,public_key:binary>>) AS active, array(named_struct('id', 'vk://a#k', 'public_key', x'01', 'rotated_at', timestamp'2024-01-01', 'verify_until', timestamp'2024-02-20')) AS rotated, cast(array() AS array<struct<id:string,public_key:binary,invalid_after:timestamp>>) AS revoked, named_struct('grace', 'P10D') AS policies"
    signed = read(spark, d, "customer").select("c_custkey", F.lit("a").alias("authority"), F.lit("vk://a#k").alias("method"), F.lit("2024-01-01").cast("timestamp").alias("created"))
    told = keys.sweep(signed, keys.flatten(spark.sql(one)), "2024-01-01", "2024-01-29", "7 days")
    return told.select("c_custkey", F.col("at").cast("timestamp_ntz").alias("moment"), "key.status")


@query("SELECT event_id, epoch_ms(TIMESTAMP '2024-01-31 00:00:00') > epoch_ms(ts) + (user_id % 20) * 86400000 + 12 * 3600000 AS stale FROM events")
def custody_stale(spark, d):
    policy = F.concat(F.lit("P"), F.col("user_id") % 20, F.lit("DT12H"))
    return read(spark, d, "events").select("event_id", temporal.custody_stale(F.col("ts").cast("timestamp"), policy, F.lit("2024-01-31").cast("timestamp")).alias("stale"))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN false ELSE epoch_ms(TIMESTAMP '2024-01-31 00:00:00') - epoch_ms(ts) > (user_id % 3) * 864000000 END AS stale FROM events")
def key_document_stale(spark, d):
    most = (F.col("user_id") % 3) * F.lit(864_000_000)
    return read(spark, d, "events").select("event_id", temporal.document_stale(F.col("ts").cast("timestamp"), most, F.lit("2024-01-31").cast("timestamp")).alias("stale"))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 29 DAY, '%Y-%m-%dT00:00:00Z') AS moved, day(last_day(o_orderdate)) AS days, year(o_orderdate) % 4 = 0 AS leap FROM orders")
def duration_arithmetic(spark, d):
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    year, month = F.year("o_orderdate"), F.month("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", temporal.add_duration(stamp, F.lit("P29D")).alias("moved"), temporal.days_in_month(year, month).cast("long").alias("days"), temporal.is_leap_year(year).alias("leap"))


@query("""
SELECT o_orderkey, CASE WHEN v IS NULL THEN 'missing' WHEN v = '' THEN 'empty' WHEN NOT regexp_full_match(v, '-?[0-9]+') THEN 'not an integer'
  WHEN starts_with(v, '-') OR v::HUGEINT < 1 THEN 'below 1' END AS reason, CASE WHEN regexp_full_match(v, '[0-9]+') AND v::HUGEINT >= 1 THEN v END AS number
FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN '1.5' WHEN 2 THEN '-' || o_orderkey WHEN 3 THEN '0' WHEN 4 THEN o_orderkey::VARCHAR END AS v FROM orders)""")
def version_guard(spark, d):
    k = F.col("o_orderkey")
    v = F.when(k % 6 == 0, "").when(k % 6 == 1, "1.5").when(k % 6 == 2, F.concat(F.lit("-"), k)).when(k % 6 == 3, "0").when(k % 6 == 4, k.cast("string"))
    return read(spark, d, "orders").select("o_orderkey", text.check_version(v)["reason"].alias("reason"), text.version_number(v).cast("string").alias("number"))


# --- privacy -------------------------------------------------------------------------------------

_MODES = {"signup": "proof-of-possession", "view": "selective-disclosure", "click": "encrypted", "purchase": "public", "error": "attestation"}


def _mode(c):
    return F.create_map(*[F.lit(x) for pair in _MODES.items() for x in pair])[c]


_MODE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _MODES.items()) + " END"
_LEVEL_SQL = "CASE {0} WHEN 'proof-of-possession' THEN 4 WHEN 'selective-disclosure' THEN 3 WHEN 'encrypted' THEN 2 WHEN 'public' THEN 1 END"


@query(f"""
WITH m AS (SELECT user_id, event_id, {_MODE_SQL} AS mode, lag({_MODE_SQL}) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events)
SELECT event_id, was AS from_mode, mode AS to_mode, coalesce({_LEVEL_SQL.format('was')} >= {_LEVEL_SQL.format('mode')}, true) AS valid FROM m WHERE was <> mode""")
def mode_transition(spark, d):
    told = chains.transitions(read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version_n"), _mode(F.col("event_type")).alias("mode")))
    return told.select(F.col("version_n").alias("event_id"), "from_mode", "to_mode", privacy.transition_valid(F.col("from_mode"), F.col("to_mode")).alias("valid"))


@query(f"""
WITH m AS (SELECT event_id, {_MODE_SQL} AS mode, CASE event_id % 3 WHEN 0 THEN 'application/octet-stream' WHEN 1 THEN 'application/index-delta+json' ELSE 'application/json-patch+json' END AS f,
  CASE event_id % 2 WHEN 0 THEN -1 ELSE 4 END AS ops, CASE event_id % 5 WHEN 0 THEN 'sha256:x' END AS a FROM events)
SELECT event_id, CASE mode WHEN 'encrypted' THEN CASE WHEN f <> 'application/octet-stream' THEN 'encrypted deltas are opaque bytes' WHEN ops <> -1 THEN 'encrypted deltas hide their operations'
  WHEN a IS NOT NULL THEN 'encrypted deltas hide what they apply to' END WHEN 'selective-disclosure' THEN CASE WHEN f <> 'application/index-delta+json' THEN 'disclosure deltas are index deltas' END END AS reason FROM m""")
def delta_restriction(spark, d):
    k = F.col("event_id")
    f = F.when(k % 3 == 0, "application/octet-stream").when(k % 3 == 1, "application/index-delta+json").otherwise("application/json-patch+json")
    return read(spark, d, "events").select("event_id", privacy.delta_reason(_mode(F.col("event_type")), f, F.when(k % 2 == 0, -1).otherwise(4), F.when(k % 5 == 0, "sha256:x"), "application/index-delta+json").alias("reason"))


@query(f"""
WITH m AS (SELECT event_id, {_MODE_SQL} AS mode, CASE WHEN event_id % 2 = 0 THEN 'p' || event_id END AS p FROM events)
SELECT event_id, CASE WHEN mode = 'attestation' THEN NULL WHEN mode = 'encrypted' THEN p ELSE 'c' || event_id END AS hash,
  CASE WHEN mode = 'attestation' THEN 'an attestation has no plaintext' WHEN mode = 'encrypted' AND p IS NULL THEN 'plaintext hash missing' END AS error FROM m""")
def logical_hash(spark, d):
    k = F.col("event_id")
    told = privacy.logical_hash(_mode(F.col("event_type")), F.concat(F.lit("c"), k), F.when(k % 2 == 0, F.concat(F.lit("p"), k)), F.lit(None).cast("string"))
    return read(spark, d, "events").select("event_id", told["hash"].alias("hash"), told["error"].alias("error"))


@query("""
SELECT doc_id, CASE WHEN coalesce(toxic, 0) = 1 AND coalesce(quality, 0) <> 1 THEN 'unverifiable' WHEN coalesce(quality, 0) = 1 AND coalesce(toxic, 0) <> 1 THEN 'full' ELSE 'partial' END AS trust
FROM documents LEFT JOIN labels USING (doc_id)""")
def attestation_trust(spark, d):
    told = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left")
    return told.select("doc_id", privacy.trust(F.lit(True), F.col("toxic") == 1, F.col("quality") == 1).alias("trust"))


@query("SELECT source AS authority, count(*) AS manifests FROM documents GROUP BY source HAVING count(*) > 1")
def authority_linkability(spark, d):
    return privacy.linkable(read(spark, d, "documents").select(F.col("source").alias("authority")))


@query("SELECT count(*) AS entries, count(*) FILTER (WHERE turn = 0) AS manifests, count(*) FILTER (WHERE turn <> 0) AS contents, sum(octet_length(encode(text)))::BIGINT AS bytes FROM conversations")
def package_counts(spark, d):
    rows = read(spark, d, "conversations").select(F.when(F.col("turn") == 0, F.concat(F.lit('{"signature":{},"version":"'), F.col("turn"), F.lit('"}'))).otherwise(F.to_json(F.struct("text"))).alias("doc"), F.octet_length("text").alias("n"))
    return rows.agg(F.count("*").alias("entries"), F.count_if(packages.is_manifest(F.col("doc"))).alias("manifests"), F.count_if(~packages.is_manifest(F.col("doc"))).alias("contents"), F.sum("n").alias("bytes"))


# --- text and JSON -------------------------------------------------------------------------------


@query("SELECT page_id, nullif(regexp_extract(url, '^https://([^/]+)/([^/]+)/(.+)$', 1), '') AS authority, nullif(regexp_extract(url, '^https://([^/]+)/([^/]+)/(.+)$', 2), '') AS type, nullif(regexp_extract(url, '^https://([^/]+)/([^/]+)/(.+)$', 3), '') AS identifier FROM pages")
def uri_parse(spark, d):
    return read(spark, d, "pages").select("page_id", text.parse_uri(F.col("url"), "https").alias("u")).select("page_id", "u.*")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_pointer_get(spark, d):
    return read(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"t":"' || event_type || '"}' AS canonical FROM events""")
def canonical_json(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    made = F.concat(F.lit('{ "t" : "'), F.col("event_type"), F.lit('", "k" : '), k.cast("string"), F.lit(".0 }"))
    return read(spark, d, "events").select("event_id", F.coalesce(jsondoc.canonical_plain(made), jsondoc.canonical_json(made)).alias("canonical"))


@query("""SELECT event_id, '{"a":{"n":' || (event_id + 1) || '},"c":true}' AS patched FROM events""")
def json_patch(spark, d):
    k = F.col("event_id")
    doc = F.concat(F.lit('{"a":{"n":'), k, F.lit('},"b":"x"}'))
    ops = F.concat(F.lit('[{"op":"replace","path":"/a/n","value":'), k + 1, F.lit('},{"op":"remove","path":"/b"},{"op":"add","path":"/c","value":true}]'))
    return read(spark, d, "events").select("event_id", jsondoc.apply_patch(doc, ops).alias("patched"))


@query("SELECT doc_id, translate(rtrim(to_base64(unhex(sha256(text))), '='), '+/', '-_') AS b64, sha256(text) AS back FROM documents")
def base64url_roundtrip(spark, d):
    raw = F.unhex(F.sha2("text", 256))
    return read(spark, d, "documents").select("doc_id", text.to_base64url(raw).alias("b64"), text.to_hex(text.from_base64url(text.to_base64url(raw))).alias("back"))


@query()
def authority_roundtrip(spark, d):
    """Authorities of made-up keys and the keys that they name again: SQL has no base 58."""
    docs = read(spark, d, "documents").select("doc_id", F.unhex(F.sha2("text", 256)).alias("pk"))
    told = docs.select("doc_id", "pk", text.derive_authority(F.col("pk")).alias("authority"))
    return told.select("doc_id", "authority", (text.public_key_of(F.col("authority")) == F.col("pk")).alias("same"))


@query()
def content_identifier(spark, d):
    """CIDv1 addresses of documents in their envelopes: SQL has no base 32."""
    docs = read(spark, d, "documents")
    return docs.select("doc_id", hashing.cid(F.col("text").cast("binary"), "Content", "JCS", "vk").alias("cid"))


# --- graph queries -------------------------------------------------------------------------------


def graph(spark, d) -> DataFrame:
    """Region, nation, customer and orders as statements."""
    def iri(kind, c):
        return F.concat(F.lit(f"{BASE}{kind}/"), c)

    region, nation = read(spark, d, "region"), read(spark, d, "nation")
    customer, orders = read(spark, d, "customer"), read(spark, d, "orders")
    parts = [
        quads.from_table(region, iri("region", F.col("r_regionkey")), "Region", {"regionName": F.col("r_name")}, {}, BASE),
        quads.from_table(nation, iri("nation", F.col("n_nationkey")), "Nation", {"nationName": F.col("n_name")}, {"inRegion": iri("region", F.col("n_regionkey"))}, BASE),
        quads.from_table(customer, iri("customer", F.col("c_custkey")), "Customer", {"customerName": F.col("c_name"), "balance": F.col("c_acctbal")}, {"inNation": iri("nation", F.col("c_nationkey"))}, BASE),
        quads.from_table(orders, iri("order", F.col("o_orderkey")), "Order", {"status": F.col("o_orderstatus"), "total": F.col("o_totalprice")}, {"by": iri("customer", F.col("o_custkey"))}, BASE),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p(name: str) -> str:
    return BASE + name


C, N, R, O = Var("c"), Var("n"), Var("r"), Var("o")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation's and region's names, by three linked triple patterns."""
    g = graph(spark, sf_dir)
    rows = patterns.bgp(g, [(C, p("inNation"), N), (N, p("inRegion"), R), (R, p("regionName"), Var("region")), (N, p("nationName"), Var("nation")), (C, p("customerName"), Var("name"))])
    return rows.select(F.col("name.value").alias("name"), F.col("nation.value").alias("nation"), F.col("region.value").alias("region"))


@query("SELECT c_name AS name, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def rdf_bgp_customer_region(spark, d):
    return flagship(spark, d)


@query("SELECT c_name AS name, o_orderstatus AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def rdf_optional(spark, d):
    g = graph(spark, d)
    rows = patterns.optional(patterns.bgp(g, [(C, p("customerName"), Var("name"))]), patterns.bgp(g, [(O, p("by"), C), (O, p("status"), Var("status"))]))
    return rows.select(F.col("name.value").alias("name"), F.col("status.value").alias("status"))


def stored_graph(spark, d) -> statements.Store:
    """The statements of ``graph`` as files of the shared folder."""
    name = f"kg_{uuid.uuid4().hex}"
    return statements.save(graph(spark, d), durable.fresh_path(spark, "kg"), name, buckets=8)


@query("SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice::DOUBLE AS total, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
def rdf_stored_star(spark, d):
    """A star of each order's statements and one of its customer's, over stored statements."""
    store = stored_graph(spark, d)
    rows = statements.bgp(store, [(O, "a", p("Order")), (O, p("status"), Var("status")), (O, p("total"), Var("total")), (O, p("by"), C), (C, p("customerName"), Var("name"))])
    told = statements.named(store, rows, O, "status", "total", "name")
    return told.select(F.regexp_extract(F.col(f"{O}.value"), r"(\d+)$", 1).cast("long").alias("k"), F.col("status.value").alias("status"), F.col("total.value").cast("double").alias("total"), F.col("name.value").alias("name"))


@query("SELECT count(*) AS n FROM (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey HAVING count(*) > 5)")
def rdf_stored_paths(spark, d):
    """Regions with more than five customers, counted on numbers, with no term looked up."""
    store = stored_graph(spark, d)
    rows = statements.bgp(store, [(C, p("inNation"), N), (N, p("inRegion"), R)])
    return rows.groupBy(R).agg(F.count("*").alias("c")).where("c > 5").agg(F.count("*").alias("n"))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def rdf_union(spark, d):
    g = graph(spark, d)
    return patterns.union(patterns.bgp(g, [(N, p("nationName"), Var("name"))]), patterns.bgp(g, [(R, p("regionName"), Var("name"))])).select(F.col("name.value").alias("name"))


@query("SELECT 'urn:vk:customer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def rdf_minus(spark, d):
    g = graph(spark, d)
    return patterns.minus(patterns.bgp(g, [(C, "a", p("Customer"))]), patterns.bgp(g, [(O, p("by"), C)])).select(F.col("c.value").alias("c"))


@query("SELECT 'urn:vk:customer/' || c_custkey AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def rdf_exists(spark, d):
    g = graph(spark, d)
    return patterns.exists(patterns.bgp(g, [(C, "a", p("Customer"))]), patterns.bgp(g, [(O, p("by"), C), (O, p("status"), Literal("F"))])).select(F.col("c.value").alias("c"))


@query("SELECT 'urn:vk:customer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def rdf_not_exists(spark, d):
    g = graph(spark, d)
    return patterns.not_exists(patterns.bgp(g, [(C, "a", p("Customer"))]), patterns.bgp(g, [(O, p("by"), C), (O, p("status"), Literal("F"))])).select(F.col("c.value").alias("c"))


@query("SELECT 'urn:vk:customer/' || c_custkey AS c FROM customer WHERE c_acctbal > 5000")
def rdf_filter(spark, d):
    rows = patterns.bgp(graph(spark, d), [(C, p("balance"), Var("b"))])
    return rows.where(terms.compare(">", F.col("b"), terms.literal(5000))).select(F.col("c.value").alias("c"))


@query("SELECT 'urn:vk:customer/' || c_custkey AS c, c_acctbal::DOUBLE * 2 AS twice FROM customer")
def rdf_bind(spark, d):
    rows = patterns.bgp(graph(spark, d), [(C, p("balance"), Var("b"))])
    twice = terms.arithmetic("*", F.col("b"), terms.literal(2))
    return rows.select(F.col("c.value").alias("c"), terms.number(twice).alias("twice"))


@query("SELECT n_name AS name, 'urn:vk:region/' || n_regionkey AS r FROM nation WHERE n_regionkey IN (1, 3)")
def rdf_values(spark, d):
    rows = patterns.bgp(graph(spark, d), [(N, p("inRegion"), R), (N, p("nationName"), Var("name"))])
    return patterns.values(rows, ["r"], [(BASE + "region/1",), (BASE + "region/3",)]).select(F.col("name.value").alias("name"), F.col("r.value").alias("r"))


@query("SELECT DISTINCT o_orderstatus AS status FROM orders")
def rdf_distinct(spark, d):
    return patterns.bgp(graph(spark, d), [(O, p("status"), Var("status"))]).select("status").distinct().select(F.col("status.value").alias("status"))


@query("SELECT n_name AS name, count(*) AS customers, min(c_name) AS first, max(c_acctbal)::DOUBLE AS most FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 4")
def rdf_group_having(spark, d):
    rows = patterns.bgp(graph(spark, d), [(C, p("inNation"), N), (N, p("nationName"), Var("name")), (C, p("customerName"), Var("cn")), (C, p("balance"), Var("b"))])
    told = rows.groupBy(F.col("name.value").alias("name")).agg(F.count("*").alias("customers"), F.min("cn.value").alias("first"), F.max(terms.number(F.col("b"))).alias("most"))
    return told.where("customers > 4")


@query("SELECT r_name AS region, string_agg(n_name, ',' ORDER BY n_name) AS nations, any_value(1) AS one FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def rdf_group_concat(spark, d):
    rows = patterns.bgp(graph(spark, d), [(N, p("inRegion"), R), (R, p("regionName"), Var("region")), (N, p("nationName"), Var("name"))])
    return rows.groupBy(F.col("region.value").alias("region")).agg(F.array_join(F.array_sort(F.collect_list("name.value")), ",").alias("nations"), F.any_value(F.lit(1)).alias("one"))


@query("SELECT c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 10)")
def rdf_subquery(spark, d):
    g = graph(spark, d)
    busy = patterns.bgp(g, [(O, p("by"), C)]).groupBy("c").agg(F.count("*").alias("n")).where("n >= 10").select("c")
    return patterns.join(busy, patterns.bgp(g, [(C, p("customerName"), Var("name"))])).select(F.col("name.value").alias("name"))


@query("""
SELECT 'urn:vk:order/' || o_orderkey AS x, 'urn:vk:nation/' || c_nationkey AS y FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'
UNION SELECT 'urn:vk:order/' || o_orderkey, 'urn:vk:customer/' || o_custkey FROM orders WHERE o_orderstatus = 'P'
UNION SELECT 'urn:vk:order/' || o_orderkey, 'urn:vk:region/' || n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'""")
def rdf_path_plus(spark, d):
    g = graph(spark, d)
    pending = patterns.bgp(g, [(Var("x"), p("status"), Literal("P"))])
    closed = patterns.reached(patterns.steps(g, [p("by"), p("inNation"), p("inRegion")]), pending)
    return patterns.join(pending, closed).select(F.col("x.value").alias("x"), F.col("y.value").alias("y"))


@query("SELECT 'urn:vk:region/' || n_regionkey AS x, c_name AS y FROM customer JOIN nation ON c_nationkey = n_nationkey")
def rdf_path_sequence_inverse(spark, d):
    """Back along two links, then on to a name: inverse steps in sequence."""
    g = graph(spark, d)
    back = patterns.sequence(patterns.steps(g, [p("inRegion")], inverse=True), patterns.steps(g, [p("inNation")], inverse=True))
    return patterns.sequence(back, patterns.steps(g, [p("customerName")])).select(F.col("x.value").alias("x"), F.col("y.value").alias("y"))


@query("""
SELECT 'urn:vk:nation/' || n_nationkey AS x, 'urn:vk:nation/' || n_nationkey AS y FROM nation
UNION SELECT 'urn:vk:nation/' || n_nationkey, 'urn:vk:region/' || n_regionkey FROM nation""")
def rdf_path_optional(spark, d):
    g = graph(spark, d)
    nations = patterns.bgp(g, [(Var("x"), "a", p("Nation"))])
    pairs = patterns.zero_or_one(patterns.steps(g, [p("inRegion")]), nations)
    return patterns.join(nations, pairs).select(F.col("x.value").alias("x"), F.col("y.value").alias("y"))


@query("SELECT 'urn:vk:nation/' || n_nationkey AS x, n_name AS y FROM nation UNION ALL SELECT 'urn:vk:nation/' || n_nationkey, 'urn:vk:Nation' FROM nation")
def rdf_path_negated(spark, d):
    g = graph(spark, d)
    return patterns.join(patterns.bgp(g, [(Var("x"), "a", p("Nation"))]), patterns.steps(g, [p("inRegion")], negated=True)).select(F.col("x.value").alias("x"), F.col("y.value").alias("y"))


@query("SELECT c_name AS name FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 10 OFFSET 5")
def rdf_order_limit(spark, d):
    rows = patterns.bgp(graph(spark, d), [(C, p("balance"), Var("b")), (C, p("customerName"), Var("name"))])
    return patterns.order_by(rows, ("b", False), ("name", True)).offset(5).limit(10).select(F.col("name.value").alias("name"))


@query("SELECT true AS answer")
def rdf_ask(spark, d):
    return patterns.ask(patterns.bgp(graph(spark, d), [(O, p("status"), Literal("F"))]))


@query("SELECT 'urn:vk:customer/' || c_custkey AS s, 'urn:vk:livesIn' AS p, 'urn:vk:region/' || n_regionkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def rdf_construct(spark, d):
    rows = patterns.bgp(graph(spark, d), [(C, p("inNation"), N), (N, p("inRegion"), R)])
    return patterns.construct(rows, [(C, p("livesIn"), R)]).select(F.col("s.value").alias("s"), F.col("p.value").alias("p"), F.col("o.value").alias("o"))


@query("SELECT 'urn:vk:region/' || r_regionkey AS s, 'urn:vk:regionName' AS p, r_name AS o FROM region UNION ALL SELECT 'urn:vk:region/' || r_regionkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:vk:Region' FROM region")
def rdf_describe(spark, d):
    g = graph(spark, d)
    return patterns.describe(g, patterns.bgp(g, [(R, "a", p("Region"))]), "r").select("s", "p", "o")


@query("""
SELECT c_custkey AS k, length(c_name) AS len, upper(c_name) AS up, lower(c_name) AS low, substr(c_name, 1, 8) AS sub, starts_with(c_name, 'Cust') AS starts, contains(c_name, '#') AS has,
  CASE WHEN contains(c_name, '#') THEN split_part(c_name, '#', 1) ELSE '' END AS before, CASE WHEN contains(c_name, '#') THEN substr(c_name, strpos(c_name, '#') + 1) ELSE '' END AS after,
  regexp_replace(c_name, '[0-9]', 'd', 'g') AS rep, regexp_matches(c_name, '7$') AS rx, md5(c_name) AS md5, sha256(c_name) AS sha, abs(c_acctbal)::DOUBLE AS ab, ceil(c_acctbal)::DOUBLE AS ce, floor(c_acctbal + 0.5)::DOUBLE AS ro FROM customer""")
def rdf_functions(spark, d):
    rows = patterns.bgp(graph(spark, d), [(C, p("customerName"), Var("name")), (C, p("balance"), Var("b"))])
    s, b = terms.text(F.col("name")), terms.number(F.col("b"))
    return rows.select(
        F.substring_index("c.value", "/", -1).cast("long").alias("k"), F.length(s).cast("long").alias("len"), F.upper(s).alias("up"), F.lower(s).alias("low"), F.substring(s, 1, 8).alias("sub"),
        F.startswith(s, F.lit("Cust")).alias("starts"), F.contains(s, F.lit("#")).alias("has"), terms.string_before(s, "#").alias("before"), terms.string_after(s, "#").alias("after"),
        F.regexp_replace(s, "[0-9]", "d").alias("rep"), s.rlike("7$").alias("rx"), F.md5(s).alias("md5"), F.sha2(s, 256).alias("sha"), F.abs(b).alias("ab"), F.ceil(b).cast("double").alias("ce"), terms.round_half_up(b).cast("double").alias("ro"),
    )


@query("""SELECT (SELECT count(*) * 2 FROM region) + (SELECT count(*) * 3 FROM nation) + (SELECT count(*) * 4 FROM customer) + (SELECT count(*) * 4 FROM orders) AS n""")
def triple_count(spark, d):
    return quads.triple_count(graph(spark, d))


@query("""
SELECT 'urn:vk:inNation' AS p, count(*) AS n FROM customer UNION ALL SELECT 'urn:vk:balance', count(*) FROM customer UNION ALL SELECT 'urn:vk:customerName', count(*) FROM customer
UNION ALL SELECT 'urn:vk:inRegion', count(*) FROM nation UNION ALL SELECT 'urn:vk:nationName', count(*) FROM nation UNION ALL SELECT 'urn:vk:regionName', count(*) FROM region
UNION ALL SELECT 'urn:vk:by', count(*) FROM orders UNION ALL SELECT 'urn:vk:status', count(*) FROM orders UNION ALL SELECT 'urn:vk:total', count(*) FROM orders
UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders)""")
def predicate_histogram(spark, d):
    return graph(spark, d).groupBy("p").agg(F.count("*").alias("n"))


@query("SELECT 'urn:vk:nation/' || n_nationkey AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type urn:vk:Nation | urn:vk:inRegion urn:vk:region/' || n_regionkey || ' | urn:vk:nationName ' || n_name AS statements FROM nation")
def group_by_subject(spark, d):
    told = quads.by_subject(graph(spark, d).where(F.startswith("s", F.lit(BASE + "nation/"))))
    return told.select("s", F.array_join(F.transform("statements", lambda x: F.concat_ws(" ", x["p"], x["o"])), " | ").alias("statements"))


# --- signatures, sealing and resolution ----------------------------------------------------------


@query("SELECT doc_id, doc_id % 5 <> 0 AS valid FROM documents")
def signatures_hold(spark, d):
    """Every document signed under a key of its own; every fifth one altered afterwards."""
    docs = read(spark, d, "documents").select("doc_id", "text", F.unhex(F.sha2(F.col("doc_id").cast("string"), 256)).alias("seed"))
    made = docs.select("doc_id", "text", crypto.sign(F.col("text"), F.col("seed")).alias("signature"), crypto.public_key(F.col("seed")).alias("pk"))
    got = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return made.select("doc_id", crypto.verify_signature(got, F.col("signature"), F.col("pk")).alias("valid"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN sha256(text) END AS opened, octet_length(encode(text)) + 16 AS sealed_bytes FROM documents")
def seal_roundtrip(spark, d):
    """Documents sealed and opened again, every third one with a wrong key."""
    key, nonce = F.unhex(F.sha2(F.col("doc_id").cast("string"), 256)), F.substring(F.unhex(F.sha2("text", 256)), 1, 12)
    rows = read(spark, d, "documents").select("doc_id", crypto.seal(key, nonce, F.col("text")).alias("sealed"), key.alias("key"), nonce.alias("nonce"))
    used = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.sha2(F.lit("wrong"), 256))).otherwise(F.col("key"))
    return rows.select("doc_id", F.sha2(crypto.unseal(used, F.col("nonce"), F.col("sealed")), 256).alias("opened"), F.octet_length("sealed").cast("long").alias("sealed_bytes"))


@query("SELECT s_suppkey, s_suppkey % 4 <> 0 AS recovered FROM supplier")
def key_recovery(spark, d):
    """A content key wrapped for each supplier's signing key; every fourth one asks under another name."""
    k = F.col("s_suppkey").cast("string")
    rows = durable.spread(read(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    rows = rows.select("s_suppkey", "s_name", F.unhex(F.sha2(F.concat(F.lit("r"), k), 256)).alias("mine"), F.unhex(F.sha2(F.concat(F.lit("e"), k), 256)).alias("once"), F.unhex(F.sha2(F.concat(F.lit("k"), k), 256)).alias("key"), F.unhex(F.substring(F.sha2(k, 256), 1, 24)).alias("nonce"))
    rows = rows.select("*", crypto.to_agreement_public(crypto.public_key(F.col("mine"))).alias("to"), crypto.to_agreement_public(crypto.public_key(F.col("once"))).alias("sent"))
    rows = rows.withColumn("wrapped", crypto.wrap(F.col("key"), crypto.to_agreement_secret(F.col("once")), F.col("to"), F.col("nonce"), "cek", F.col("s_name")))
    name = F.when(F.col("s_suppkey") % 4 == 0, "someone else").otherwise(F.col("s_name"))
    got = crypto.unwrap(F.col("wrapped"), crypto.to_agreement_secret(F.col("mine")), F.col("sent"), F.col("nonce"), "cek", name)
    return rows.select("s_suppkey", F.coalesce(got == F.col("key"), F.lit(False)).alias("recovered"))


def _store(spark, d):
    """Conversations as chains of signed manifests, and the blobs that hold them and their content.

    Every manifest is version, chain and content of one turn, under one key. The content of turn 2 of
    every fourth conversation is altered in the store.
    """
    seed = F.unhex(F.sha2(F.lit("catalogue"), 256))
    turns = read(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), F.to_json(F.struct("conv_id", "role", "text", "turn")).alias("body"))
    turns = turns.withColumns({"content": jsondoc.canonical_json(F.col("body")), "authority": text.derive_authority(crypto.public_key(seed)), "pk": crypto.public_key(seed)})
    firsts = Window.partitionBy("conv_id").orderBy("turn")
    turns = durable.cut(turns.withColumn("n", F.row_number().over(firsts)))
    stamp = F.lit("2025-01-01T00:00:00Z")
    uri = F.concat(F.lit("vk://"), F.col("authority"), F.lit("/data/"), F.col("conv_id"))
    built = manifests.build(uri, F.col("n"), F.lit("main"), stamp, manifests.content_record(F.col("content"), "application/json"))
    made = turns.select("conv_id", "turn", "n", uri.alias("uri"), "pk", "content", manifests.sign(built, seed, F.lit("key-1"), stamp).alias("doc"))
    made = durable.cut(made.withColumn("manifest_hash", hashing.sha256(F.col("doc"))))
    bad = (F.col("turn") == 2) & (F.col("conv_id") % 4 == 0)
    stored = made.select(F.col("manifest_hash").alias("hash"), F.col("doc").cast("binary").alias("bytes")).unionByName(made.select(hashing.sha256(F.col("content")).alias("hash"), F.when(bad, F.lit("altered")).otherwise(F.col("content")).cast("binary").alias("bytes")))
    return made, stored.dropDuplicates(["hash"])


@query("""SELECT conv_id, turn::BIGINT AS turn, NOT (turn = 2 AND conv_id % 4 = 0) AND conv_id % 5 <> 0 AS ok,
  CASE WHEN conv_id % 5 = 0 THEN 'MANIFEST_NOT_FOUND' WHEN turn = 2 AND conv_id % 4 = 0 THEN 'STORAGE_CORRUPTION' END AS error_code FROM conversations""")
def resolve_turns(spark, d):
    """Every turn resolved by its address; every fifth conversation asks for what is not there."""
    made, stored = _store(spark, d)
    asked = made.select("conv_id", "turn", "uri", F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("sha256:"), F.col("conv_id"), F.lit("-"), F.col("turn"))).otherwise(F.col("manifest_hash")).alias("manifest_hash"), F.col("pk").alias("public_key"))
    told = resolve.resolve(asked.drop("conv_id", "turn"), stored)
    return told.join(asked, ["uri", "manifest_hash"]).select("conv_id", "turn", "ok", "error_code")


@query("""SELECT n_nationkey, sha256('<urn:vk:nation/' || n_nationkey || '> <urn:vk:is> _:c14n0 .' || chr(10) || '_:c14n0 <urn:vk:in> <urn:vk:region/' || n_regionkey || '> .' || chr(10) || '_:c14n0 <urn:vk:name> "' || n_name || '" .' || chr(10)) AS digest FROM nation""")
def canonical_graphs(spark, d):
    """One small graph with a blank node for each nation, named at random, in canonical form."""
    n = read(spark, d, "nation")
    node = F.concat(F.lit("_:x"), F.hex("n_name"))
    lines = [F.concat(node, F.lit(' <urn:vk:name> "'), F.col("n_name"), F.lit('" .')), F.concat(F.lit("<urn:vk:nation/"), F.col("n_nationkey"), F.lit("> <urn:vk:is> "), node, F.lit(" .")), F.concat(node, F.lit(" <urn:vk:in> <urn:vk:region/"), F.col("n_regionkey"), F.lit("> ."))]
    told = canonical.canonicalise(n.select(F.col("n_nationkey").alias("doc_id"), F.explode(F.array(*lines)).alias("quad")))
    return told.select(F.col("doc_id").alias("n_nationkey"), F.sha2("text", 256).alias("digest"))


@query("SELECT 'urn:vk:customer/' || c_custkey AS s, c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def json_ld_graph(spark, d):
    """Customers as JSON-LD documents, loaded as a graph and asked for a name inside a nested node."""
    both = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    doc = F.to_json(F.struct(F.create_map(F.lit("@vocab"), F.lit(BASE)).alias("@context"), F.concat(F.lit(BASE + "customer/"), F.col("c_custkey")).alias("@id"), F.lit("Customer").alias("@type"), F.col("c_name").alias("name"), F.struct(F.lit("Nation").alias("@type"), F.col("n_name").alias("name")).alias("from")))
    g = graphs.load_json_ld(both.select(F.col("c_custkey").alias("doc_id"), doc.alias("text")), "doc_id", "text")
    rows = patterns.bgp(g, [(C, "a", p("Customer")), (C, p("name"), Var("name")), (C, p("from"), N), (N, p("name"), Var("nation"))])
    return rows.select(F.col("c.value").alias("s"), F.col("name.value").alias("name"), F.col("nation.value").alias("nation"))


@query("SELECT 'urn:vk:order/' || o_orderkey AS o, 'urn:vk:status/' || o_orderstatus AS graph FROM orders")
def rdf_named_graphs(spark, d):
    """Statements told in named graphs, and the graph of each bound to a variable."""
    orders = read(spark, d, "orders")
    line = F.concat(F.lit(f"<{BASE}order/"), F.col("o_orderkey"), F.lit(f'> <{BASE}total> "'), F.col("o_totalprice"), F.lit(f'" <{BASE}status/'), F.col("o_orderstatus"), F.lit("> ."))
    g = graphs.load_n_quads(orders.select(F.col("o_orderkey").alias("doc_id"), line.alias("text")), "doc_id", "text")
    return patterns.pattern(g, O, p("total"), Var("t"), Var("g")).select(F.col("o.value").alias("o"), F.col("g.value").alias("graph"))


# --- records, rules and round trips --------------------------------------------------------------


@query("""
SELECT doc_id, coalesce(lang, '') AS tag, coalesce(lang = 'en', false) AS english, CASE WHEN lang IS NULL THEN 'http://www.w3.org/2001/XMLSchema#string' ELSE 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' END AS kind,
  false AS uri, true AS lit, false AS numeric, n_chars > 0 AS truth, true AS same FROM documents""")
def rdf_term_functions(spark, d):
    """Tests on terms and their parts, over titles told in the document's language."""
    t = terms.term("literal", F.concat(F.lit("doc "), F.col("doc_id")), None, F.col("lang"))
    count = terms.term("literal", F.col("n_chars"), F.lit(terms.XSD + "integer"))
    docs = read(spark, d, "documents").select("doc_id", t.alias("t"), count.alias("n"))
    t, n = F.col("t"), F.col("n")
    return docs.select("doc_id", terms.lang(t).alias("tag"), terms.lang_matches(terms.lang(t), "en").alias("english"), terms.datatype(t).alias("kind"), terms.is_uri(t).alias("uri"), terms.is_literal(t).alias("lit"), terms.is_numeric(t).alias("numeric"), terms.truth(n).alias("truth"), terms.same_term(t, t).alias("same"))


@query("""
SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, 13 AS h, 'Z' AS tz, epoch_ms(o_orderdate::TIMESTAMP) + 48600250 AS millis,
  strftime(o_orderdate, '%Y-%m-%dT13:30:00.250Z') AS shown, CASE WHEN o_orderdate < DATE '1995-01-01' THEN -1 ELSE 1 END AS place FROM orders""")
def rdf_dates(spark, d):
    """Parts of timestamps told as text, their milliseconds, their text again and their order."""
    rows = read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T13:30:00.25Z'").alias("told"))
    told, at = F.col("told"), temporal.parse_stamp(F.col("told"))
    parts = {"y": F.year(at), "m": F.month(at), "d": F.day(at), "h": F.hour(at)}
    return rows.select("o_orderkey", *[c.cast("long").alias(k) for k, c in parts.items()], terms.timezone_of(told).alias("tz"), temporal.epoch_millis(told).alias("millis"), temporal.format_stamp(at).alias("shown"), temporal.compare_stamps(told, F.lit("1995-01-01T00:00:00Z")).alias("place"))


@query("SELECT event_id, ((user_id % 3) * 365 + 30 + user_id % 7) * 86400000 + (user_id % 24) * 3600000 + 90000 AS millis FROM events")
def full_duration(spark, d):
    u = F.col("user_id")
    told = F.concat(F.lit("P"), u % 3, F.lit("Y1M"), u % 7, F.lit("DT"), u % 24, F.lit("H1M30S"))
    return read(spark, d, "events").select("event_id", temporal.duration_millis(told).alias("millis"))


@query("""
SELECT 'urn:vk:order/' || o_orderkey AS x, 'urn:vk:order/' || o_orderkey AS y FROM orders WHERE o_orderstatus = 'P'
UNION SELECT 'urn:vk:order/' || o_orderkey, 'urn:vk:customer/' || o_custkey FROM orders WHERE o_orderstatus = 'P'
UNION SELECT 'urn:vk:order/' || o_orderkey, 'urn:vk:nation/' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'""")
def rdf_path_star(spark, d):
    g = graph(spark, d)
    pending = patterns.bgp(g, [(Var("x"), p("status"), Literal("P"))])
    closed = patterns.zero_or_more(patterns.steps(g, [p("by"), p("inNation")]), pending)
    return patterns.join(pending, closed).select(F.col("x.value").alias("x"), F.col("y.value").alias("y"))


@query("SELECT 'urn:vk:nation/' || n_nationkey AS x, n_name AS y FROM nation UNION ALL SELECT 'urn:vk:region/' || r_regionkey, r_name FROM region")
def rdf_path_alternative(spark, d):
    return patterns.steps(graph(spark, d), [p("nationName"), p("regionName")]).select(F.col("x.value").alias("x"), F.col("y.value").alias("y"))


@query("""
SELECT 'urn:vk:part/' || p_partkey AS s, 'urn:vk:' || k AS kind FROM part, (VALUES ('Made'), ('Thing'), ('Any')) t(k) WHERE p_partkey % 2 = 0
UNION ALL SELECT 'urn:vk:part/' || p_partkey, 'urn:vk:' || k FROM part, (VALUES ('Thing'), ('Any')) t(k) WHERE p_partkey % 2 = 1""")
def subclass_types(spark, d):
    """Types that follow from a chain of two subclass statements."""
    k = F.col("p_partkey")
    made = quads.from_table(read(spark, d, "part").where(k % 2 == 0), F.concat(F.lit(BASE + "part/"), k), "Made", {}, {}, BASE)
    other = quads.from_table(read(spark, d, "part").where(k % 2 == 1), F.concat(F.lit(BASE + "part/"), k), "Thing", {}, {}, BASE)
    lines = spark.sql(f"SELECT -1 AS doc_id, '<{BASE}Made> <{graphs.SUBCLASS}> <{BASE}Thing> .\n<{BASE}Thing> <{graphs.SUBCLASS}> <{BASE}Any> .' AS text")
    order = graphs.load_n_quads(lines, "doc_id", "text").select(*made.columns)
    told = graphs.subclass_closure(made.unionByName(other).unionByName(order))
    return told.where(F.col("p") == quads.RDF_TYPE).select("s", F.col("o").alias("kind"))


@query("""SELECT page_id, 'vk://' || split_part(replace(url, 'https://', ''), '/', 1) || '/page/' || page_id AS uri, split_part(replace(url, 'https://', ''), '/', 1) AS authority, 'key-' || page_id AS fragment,
  CASE WHEN starts_with(url, 'https://www.') THEN 'w:' || substr(url, 13) WHEN starts_with(url, 'https://') THEN 'h:' || substr(url, 9) ELSE url END AS short FROM pages""")
def uri_build(spark, d):
    rows = read(spark, d, "pages").select("page_id", "url", text.authority_of(F.col("url"), "https").alias("authority"))
    uri = text.build_uri("vk", F.col("authority"), F.lit("page"), F.col("page_id").cast("string"))
    return rows.select("page_id", uri.alias("uri"), "authority", text.key_fragment(F.concat(uri, F.lit("#key-"), F.col("page_id"))).alias("fragment"), text.shorten(F.col("url"), {"w": "https://www.", "h": "https://"}).alias("short"))


@query("""
WITH v AS (SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT event_id, event_id > was AS rises FROM v WHERE event_id >= 1 AND (was IS NULL OR was >= 1)""")
def version_rises(spark, d):
    """Whether the version text of each event is above the one before it in time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("was"))
    told = text.increases(F.col("event_id").cast("string"), F.col("was").cast("string"))
    return rows.where("event_id >= 1 AND (was IS NULL OR was >= 1)").select("event_id", told.alias("rises"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'sha256' WHEN 1 THEN 'cidv1' END AS algorithm, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN true END AS holds FROM documents WHERE text IS NOT NULL""")
def hash_registry(spark, d):
    """Addresses of two algorithms and of two unknown kinds, each checked by what it names."""
    data, k = F.col("text").cast("binary"), F.col("doc_id") % 4
    address = F.when(k == 0, hashing.sha256(data)).when(k == 1, hashing.cid(data, "Content", "JCS", "vk")).when(k == 2, F.concat(F.lit("md5:"), F.md5(data))).otherwise(F.lit("b:1"))
    return read(spark, d, "documents").where("text is not null").select("doc_id", hashing.algorithm_of(address).alias("algorithm"), hashing.verify(address, data).alias("holds"))


@query("""SELECT event_id, '[{"op":"replace","path":"/n","value":' || (event_id + 1) || '},{"op":"remove","path":"/o"}]' AS ops, '{"n":' || (event_id + 1) || '}' AS patched FROM events""")
def json_diff(spark, d):
    """The ops between two documents, and the first one with them applied."""
    k = F.col("event_id")
    a, b = F.concat(F.lit('{"n":'), k, F.lit(',"o":1}')), F.concat(F.lit('{"n":'), k + 1, F.lit("}"))
    rows = read(spark, d, "events").select("event_id", a.alias("a"), jsondoc.diff_json(a, b).alias("ops"))
    shown = F.array_sort(F.from_json("ops", "array<struct<path:string,op:string,value:bigint>>"))
    shown = F.transform(shown, lambda x: F.struct(x["op"].alias("op"), x["path"].alias("path"), x["value"].alias("value")))
    return rows.select("event_id", F.to_json(shown).alias("ops"), jsondoc.apply_patch(F.col("a"), F.col("ops")).alias("patched"))


@query("""SELECT c_custkey, '{"AUTH":"x","id":"vk://a' || c_custkey || '/data","list":["a' || c_custkey || '",1]}' AS filled FROM customer""")
def placeholder_fill(spark, d):
    """A placeholder replaced in string values, and left alone where it is a key."""
    doc = F.lit('{"list":["AUTH",1],"id":"vk://AUTH/data","AUTH":"x"}')
    return read(spark, d, "customer").select("c_custkey", jsondoc.fill_placeholder(doc, "AUTH", F.concat(F.lit("a"), F.col("c_custkey"))).alias("filled"))


@query(f"""
WITH m AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN CASE WHEN event_id % 7 = 0 THEN 'x-other' ELSE {_MODE_SQL} END END AS stated FROM events)
SELECT event_id, coalesce(stated, 'public') AS mode, coalesce(stated, '') <> 'x-other' AS known,
  CASE WHEN event_id % 3 = 0 THEN 'an ephemeral authority refers to a key document' END AS anonymous,
  event_id % 2 = 0 OR event_id % 5 = 0 AS addressing, event_id % 10 < 5 AS stale FROM m""")
def privacy_rules(spark, d):
    """The stated or default mode and whether it is known, the anonymous rule, addressing, expiry."""
    k = F.col("event_id")
    stated = F.when(k % 4 != 0, F.when(k % 7 == 0, "x-other").otherwise(_mode(F.col("event_type"))))
    method = F.when(k % 3 == 0, "vk://a/key/main#1").otherwise("vk://a#1")
    addressing = privacy.addressing_consistent(F.when(k % 2 == 0, "raw").otherwise("cid"), F.when(k % 5 != 0, "raw"))
    stale = privacy.attestation_stale(F.concat(F.lit("2024-01-0"), k % 10, F.lit("T00:00:00Z")), F.lit("2024-01-05T00:00:00Z"))
    mode = privacy.mode_of(stated)
    return read(spark, d, "events").select("event_id", mode.alias("mode"), privacy.known_mode(mode).alias("known"), privacy.anonymous_reason(F.lit("ephemeral"), method).alias("anonymous"), addressing.alias("addressing"), stale.alias("stale"))


@query("""
SELECT event_id, NOT (event_id % 5 > 1 AND event_id % 2 = 0) AS genesis, CASE WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN 'JCS needs a JSON patch' WHEN event_id % 2 = 1 AND event_id % 3 <> 1 THEN 'URDNA2015 needs an RDF patch' END AS coupling,
  CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'valid' WHEN event_id % 5 = 0 THEN 'warning' ELSE 'invalid' END AS delta FROM events""")
def manifest_rules(spark, d):
    """Genesis validity, delta and profile coupling, and the verdict on a delta."""
    k = F.col("event_id")
    chain = F.when(k % 2 == 1, F.struct(F.lit("x").alias("previous")))
    profile = F.when(k % 2 == 0, "JCS").otherwise("URDNA2015")
    kind = F.when(k % 3 == 0, "application/json-patch+json").when(k % 3 == 1, "application/rdf-patch").otherwise("text/plain")
    return read(spark, d, "events").select("event_id", chains.genesis_valid(k % 5, chain).alias("genesis"), chains.coupling_reason(profile, kind).alias("coupling"), chains.delta_verdict(k % 4 != 0, k % 3 == 0, k % 5 == 0).alias("delta"))


@query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'content present' WHEN 1 THEN 'type' WHEN 2 THEN 'missing timing' WHEN 3 THEN 'mode' WHEN 4 THEN 'missing evidence' END AS reason FROM events""")
def attestation_structure(spark, d):
    """The first structural fault of attestations made with one fault each, and of whole ones."""
    k = F.col("event_id") % 6
    whole = ["@context", "@id", "@type", "version", "branch", "timing", "privacy", "attestation"]
    fields = F.when(k == 0, F.array(*map(F.lit, [*whole, "content"]))).when(k == 2, F.array(*[F.lit(x) for x in whole if x != "timing"])).otherwise(F.array(*map(F.lit, whole)))
    parts = F.when(k == 4, F.array(F.lit("subject"), F.lit("claim"))).otherwise(F.array(F.lit("subject"), F.lit("claim"), F.lit("evidence")))
    told = privacy.attestation_reason(fields, F.when(k == 1, "Other").otherwise("Att"), F.when(k == 3, "public").otherwise("attestation"), parts, "Att")
    return read(spark, d, "events").select("event_id", told.alias("reason"))


@query("""
WITH s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents),
t AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS idx FROM s)
SELECT doc_id, count(*) AS shown, count(*) FILTER (WHERE idx % 2 = 0) AS valid FROM t WHERE idx = 0 OR doc_id % 3 = 0 OR (doc_id % 3 = 1 AND idx IN (2, 3)) GROUP BY doc_id""")
def selective_disclosure(spark, d):
    """Statements that each document's recipient may see, odd ones altered on the way, checked one by one."""
    docs, k = read(spark, d, "documents"), F.col("doc_id") % 3
    index = privacy.statement_index(docs, "doc_id", "text", F.lit(b"salt"))
    own = F.when(k == 1, F.array(F.lit(2), F.lit(3))).when(k == 2, F.array().cast("array<int>"))
    seen = privacy.disclosed(index, F.array(F.lit(0)), own)
    got = F.when(F.col("idx") % 2 == 1, F.concat("statement", F.lit("!"))).otherwise(F.col("statement"))
    return seen.groupBy("doc_id").agg(F.count("*").alias("shown"), F.count_if(privacy.statement_valid(got, F.lit(b"salt"), F.col("hash"))).alias("valid"))


@query("""
SELECT 'vk://' || conv_id AS uri, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE count(DISTINCT role || text) END AS entries, CASE WHEN conv_id % 3 = 0 THEN 'integrity' END AS error FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def package_roundtrip(spark, d):
    """A package for each conversation, written and read; every third one holds an altered entry."""
    body = F.concat("role", "text")
    turns = read(spark, d, "conversations").where("text is not null").select("conv_id", F.concat(F.lit("vk://"), F.col("conv_id")).alias("uri"), hashing.sha256(body).alias("hash"), body.alias("body")).dropDuplicates(["uri", "hash"])
    data = F.when(F.col("conv_id") % 3 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")).cast("binary")
    heads = turns.select("uri").distinct().select("uri", F.lit("key:a").alias("authority"), F.unhex(F.sha2("uri", 256)).alias("public_key"))
    told = packages.load(packages.export(heads, turns.select("uri", "hash", data.alias("bytes"))))
    return told.groupBy("uri").agg(F.count("hash").alias("entries"), F.max("error").alias("error"))


@query("""
SELECT 'urn:vk:nation/' || n_nationkey AS s, n_name AS name, 'urn:vk:region/' || n_regionkey AS region, 'urn:vk:graph/' || (n_nationkey % 3) AS graph FROM nation""")
def trig_graph(spark, d):
    """Nations as TriG documents, each in a graph of its own kind, asked for what a nested node says."""
    k = F.col("n_nationkey")
    doc = F.concat(F.lit(f"@prefix v: <{BASE}> .\nGRAPH <{BASE}graph/"), k % 3, F.lit(f"> {{ <{BASE}nation/"), k, F.lit('> a v:Nation ;\n  v:told [ v:name "'), F.col("n_name"), F.lit(f'" ; v:in <{BASE}region/'), F.col("n_regionkey"), F.lit("> ] . }"))
    g = graphs.build_graph(read(spark, d, "nation").select(k.alias("doc_id"), doc.alias("text")), "doc_id", "text", "application/trig")
    told = patterns.pattern(g, N, p("told"), Var("b"), Var("g"))
    rows = patterns.join(patterns.join(told, patterns.pattern(g, Var("b"), p("name"), Var("name"), Var("g"))), patterns.pattern(g, Var("b"), p("in"), R, Var("g")))
    return rows.select(F.col("n.value").alias("s"), F.col("name.value").alias("name"), F.col("r.value").alias("region"), F.col("g.value").alias("graph"))


@query("""
WITH RECURSIVE up AS (SELECT DISTINCT p_size AS k, p_size AS c FROM part UNION SELECT k, c // 2 FROM up WHERE c > 1),
t AS (SELECT 'size' || c AS class, p_partkey::VARCHAR AS node FROM part JOIN up ON k = p_size
      UNION SELECT 'Thing', p_partkey::VARCHAR FROM part UNION SELECT 'Brand', p_brand FROM part)
SELECT class, count(*) AS n FROM t GROUP BY class""")
def rdf_entailed(spark, d):
    """Parts typed by a tree of sizes, and a property whose superproperty has a domain and a range."""
    part = read(spark, d, "part")
    node = F.concat(F.lit(BASE + "part/"), "p_partkey")
    parts = quads.from_table(part, node, "x", {}, {"made": F.concat(F.lit(BASE + "brand/"), F.replace("p_brand", F.lit("#"), F.lit("-")))}, BASE).where(F.col("p") != quads.RDF_TYPE)
    none = F.lit(None).cast("string")

    def told(rows, s, p, o):
        return rows.select(none.alias("graph"), s.alias("s"), F.lit("uri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit("uri").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"), F.lit("").alias("doc_id"))

    size = lambda c: F.concat(F.lit(BASE + "size"), c.cast("int").cast("string"))
    one = spark.range(1)
    sizes = part.select("p_size").distinct().select(F.explode(F.expr("filter(transform(sequence(0, 31), i -> p_size div cast(power(2, i) as bigint)), x -> x > 1)")).alias("c")).distinct()
    schema = [told(sizes, size(F.col("c")), entailment.SUBCLASS, size(F.floor(F.col("c") / 2))), told(one, F.lit(BASE + "made"), entailment.SUBPROPERTY, F.lit(BASE + "linked")), told(one, F.lit(BASE + "linked"), entailment.DOMAIN, F.lit(BASE + "Thing")), told(one, F.lit(BASE + "linked"), entailment.RANGE, F.lit(BASE + "Brand"))]
    table = parts.unionByName(told(part, node, quads.RDF_TYPE, size(F.col("p_size"))))
    for more in schema:
        table = table.unionByName(more)
    types = entailment.entail(table).where(F.col("p") == quads.RDF_TYPE).select("s", "o").distinct()
    return types.groupBy(F.replace("o", F.lit(BASE), F.lit("")).alias("class")).agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey AS k, sha256(CASE WHEN s_suppkey % 2 = 0
  THEN '_:c14n0 <urn:vk:knows> _:c14n1 .' || chr(10) || '_:c14n1 <urn:vk:knows> _:c14n0 .' || chr(10)
  ELSE '_:c14n0 <urn:vk:of> "' || s_name || '" .' || chr(10) || '_:c14n1 <urn:vk:of> "' || s_name || '" .' || chr(10) || '_:c14n2 <urn:vk:of> "' || s_name || '" .' || chr(10) END) AS digest FROM supplier""")
def canonical_ties(spark, d):
    """Graphs whose blank nodes look alike: two that know each other, or three with the same name; paths decide on their names."""
    rows = read(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), "s_name")
    node = [F.concat(F.lit("_:"), F.substring(F.sha2(F.concat("s_name", F.lit(str(k))), 256), 1, 8), F.lit(str(k))) for k in range(3)]
    pair = F.array(F.concat(node[0], F.lit(" <urn:vk:knows> "), node[1], F.lit(" .")), F.concat(node[1], F.lit(" <urn:vk:knows> "), node[0], F.lit(" .")))
    three = F.array(*[F.concat(n, F.lit(' <urn:vk:of> "'), F.col("s_name"), F.lit('" .')) for n in node])
    told = canonical.canonicalise(rows.select("doc_id", F.explode(F.when(F.col("doc_id") % 2 == 0, pair).otherwise(three)).alias("quad")))
    return told.select(F.col("doc_id").alias("k"), F.sha2("text", 256).alias("digest"))


@query("""
SELECT n_nationkey AS k, n_name AS name, 'a "quoted" ' || n_name AS note, n_nationkey % 5 = 0 AS broken FROM nation""")
def sql_statements(spark, d):
    """Turtle, N-Quads and JSON-LD texts of nations, read by SQL in lateral joins; every fifth N-Quads text has a malformed line."""
    table_functions.register(spark)
    n, view = read(spark, d, "nation"), f"texts_{uuid.uuid4().hex}"
    k, quoted = F.col("n_nationkey").cast("string"), F.concat(F.lit('"a \\"quoted\\" '), "n_name", F.lit('"'))
    lines = F.concat(F.lit("<urn:vk:n/"), k, F.lit("> <urn:vk:note> "), quoted, F.lit(" .\n"), F.when(F.col("n_nationkey") % 5 == 0, "no statement .\n").otherwise(""))
    turtle = F.concat(F.lit("@prefix v: <urn:vk:> . <urn:vk:n/"), k, F.lit('> v:name """'), "n_name", F.lit('"""@en ; v:in [ v:key '), k, F.lit(" ] ."))
    doc = F.to_json(F.struct(F.create_map(F.lit("@vocab"), F.lit(BASE)).alias("@context"), F.concat(F.lit("urn:vk:n/"), k).alias("@id"), F.col("n_name").alias("name")))
    n.select("n_nationkey", lines.alias("lines"), turtle.alias("turtle"), doc.alias("doc")).createOrReplaceTempView(view)
    return spark.sql(f"""
      WITH a AS (SELECT n_nationkey, max(s.o) AS note, max(s.error IS NOT NULL) AS broken FROM {view}, LATERAL n_quads_statements(lines) s GROUP BY n_nationkey),
      b AS (SELECT n_nationkey, max(CASE WHEN s.p = 'urn:vk:name' AND s.o_lang = 'en' THEN s.o END) AS name, count_if(s.s_kind = 'bnode' AND s.o_dt LIKE '%integer') AS keys FROM {view}, LATERAL turtle_statements(turtle) s GROUP BY n_nationkey),
      c AS (SELECT n_nationkey, s.o AS name FROM {view}, LATERAL json_ld_statements(doc) s WHERE s.error IS NULL)
      SELECT a.n_nationkey AS k, b.name, note, broken FROM a JOIN b ON a.n_nationkey = b.n_nationkey AND keys = 1 JOIN c ON a.n_nationkey = c.n_nationkey AND b.name = c.name""")


@query("""
WITH o AS (SELECT s_suppkey AS k, s_nationkey AS n, lead(s_suppkey) OVER w AS next, first_value(s_suppkey) OVER w AS first FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey))
SELECT k, count(*) OVER (PARTITION BY n) + 1 AS reached, first AS component FROM o""")
def rdf_path_cycles(spark, d):
    """Suppliers of a nation in a ring, each ring with a way out to its nation: what each reaches, and its ring's first member."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    rows = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.lead("s_suppkey").over(w).alias("next"), F.row_number().over(w).alias("n"))
    first = rows.where("n = 1").select("s_nationkey", F.col("s_suppkey").alias("first"))
    ring = rows.join(first, "s_nationkey").select(F.col("s_suppkey").alias("x"), F.coalesce("next", "first").alias("y"))
    out = first.select(F.col("first").alias("x"), (-1 - F.col("s_nationkey")).cast("long").alias("y"))
    pairs = durable.cut(ring.unionByName(out))
    parts = durable.cut(patterns.strong_components(pairs))
    told = patterns.reach_counts(pairs, parts).withColumnRenamed("n", "reached")
    return told.join(parts.where("x >= 0"), "x").select(F.col("x").alias("k"), "reached", "component")
