"""A statement table as files: terms by number, statements by predicate and subject.

``save`` writes two Parquet tables below one folder. ``terms`` is the dictionary: a number of 64 bits for each
different term, a hash of it. ``facts`` has graph, s, p, o as such numbers, a folder for each predicate
and in it a bucket for each hash of the subject, sorted. A pattern with a predicate opens that predicate's
files only, and patterns that share their subject are joined bucket by bucket, without a shuffle. Solutions
are numbers until ``named`` looks their terms up.

Two terms of one hash are told apart when the table is written: all but the first get a number of their own.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import terms
from attestry.operators.patterns import Literal, Var, join
from attestry.operators.quads import RDF_TYPE
from attestry.plans.durable import cut

PARTS = ("kind", "value", "dt", "lang")
_TERMS = "kind string, value string, dt string, lang string, id bigint"


@dataclass
class Store:
    """A stored statement table of a session: the names of its two tables in the catalog."""

    spark: SparkSession
    name: str

    @property
    def terms(self) -> DataFrame:
        return self.spark.table(f"{self.name}_terms")

    @property
    def facts(self) -> DataFrame:
        return self.spark.table(f"{self.name}_facts")


def _hash(x: Column, bits: int) -> Column:
    """A term's first number; absent parts count as empty ones, at their places."""
    return F.shiftrightunsigned(F.xxhash64(*[F.coalesce(x[p], F.lit("")) for p in PARTS]), 64 - bits) if bits < 64 else F.xxhash64(*[F.coalesce(x[p], F.lit("")) for p in PARTS])


def _term(kind: Column, value: Column, dt: Column | None = None, lang: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(*[(none if c is None else c).alias(p) for p, c in zip(PARTS, (kind, value, dt, lang))])


def save(quads: DataFrame, folder: str, name: str, buckets: int = 64, bits: int = 64) -> Store:
    """Writes the statements, each once, below ``folder`` and registers them as ``name``; see ``load`` for another session.

    The documents that say a statement are not kept. ``buckets`` is how many files a predicate has: a subject's
    statements with a predicate lie in one of them. ``bits`` shortens the hashes, for tests.
    """
    spark, uri = quads.sparkSession, F.lit("uri")
    whole = quads.select(
        F.when(F.col("graph").isNotNull(), _term(uri, F.col("graph"))).alias("graph"), _term(F.col("s_kind"), F.col("s")).alias("s"), _term(uri, F.col("p")).alias("p"),
        _term(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang")).alias("o"),
    )
    none = F.lit(None).cast("string")
    few = quads.select(F.explode(F.array("graph", "p")).alias("value")).where("value is not null").distinct()
    sides = [few.select(uri, "value", none, none), quads.select("s_kind", "s", none, none), quads.select("o_kind", "o", "o_dt", "o_lang")]
    each = reduce(DataFrame.unionByName, [x.toDF(*PARTS) for x in sides]).distinct()
    _in_order(each.withColumn("id", _hash(F.struct(*PARTS), bits))).write.mode("error").parquet(f"{folder}/terms")
    hashed, again = spark.read.schema(_TERMS).parquet(f"{folder}/terms"), None
    clashing = cut(hashed.groupBy("id").count().where("count > 1").select("id"))
    if not clashing.isEmpty():  # of 10 ** 10 terms some three; all but the first of a hash are numbered anew
        hashed = cut(hashed)
        first = hashed.join(clashing, "id", "left_semi").groupBy("id").agg(F.min(F.struct(*PARTS)).alias("first"))
        again = hashed.join(first, "id").where(~F.struct(*PARTS).eqNullSafe(F.col("first")))
        again = cut(again.select(*PARTS, F.xxhash64(F.lit("again"), *[F.coalesce(p, F.lit("")) for p in PARTS]).alias("other")))
        taken = again.select(F.col("other").alias("id")).unionByName(hashed.select("id").distinct())
        if not taken.groupBy("id").count().where("count > 1").isEmpty():
            raise RuntimeError("terms of one hash have one second hash")
        hashed = hashed.join(again, _same(hashed, again), "left").select(*[hashed[p] for p in PARTS], F.coalesce("other", "id").alias("id"))
        _in_order(hashed).write.mode("overwrite").parquet(f"{folder}/terms")
    _register_terms(spark, folder, name)
    numbers = whole.select(*[F.when(F.col(c).isNotNull(), _hash(F.col(c), bits)).alias(c) for c in ("graph", "s", "p", "o")]) if again is None else _renumbered(whole, again, bits)
    dealt = numbers.withColumn("bucket", F.pmod(F.hash("s"), F.lit(buckets))).repartition("p", "bucket").distinct().drop("bucket")  # one shuffle for both
    dealt.write.mode("error").partitionBy("p").bucketBy(buckets, "s").sortBy("s").option("path", f"{folder}/facts").saveAsTable(f"{name}_facts")
    spark.createDataFrame([(json.dumps({"buckets": buckets}),)], "value string").coalesce(1).write.mode("error").text(f"{folder}/layout")
    return Store(spark, name)


def _in_order(terms: DataFrame) -> DataFrame:
    return terms.repartition("id").sortWithinPartitions("id")


def _quoted(folder: str) -> str:
    return folder.replace("'", "\\'")


def _register_terms(spark: SparkSession, folder: str, name: str) -> None:
    spark.sql(f"CREATE TABLE {name}_terms ({_TERMS}) USING parquet LOCATION '{_quoted(folder)}/terms'")


def _same(a: DataFrame, b: DataFrame) -> Column:
    out = F.lit(True)
    for p in PARTS:
        out = out & a[p].eqNullSafe(b[p])
    return out


def _renumbered(whole: DataFrame, again: DataFrame, bits: int) -> DataFrame:
    out = whole
    for c in ("graph", "s", "p", "o"):
        told = again.select(F.struct(*PARTS).alias("__term"), F.col("other").alias("__other"))
        number = F.when(F.col(c).isNotNull(), F.coalesce("__other", _hash(F.col(c), bits)))
        out = out.join(told, F.to_json(F.col(c), {"ignoreNullFields": "false"}) == F.to_json("__term", {"ignoreNullFields": "false"}), "left").withColumn(f"__{c}", number).drop("__term", "__other")
    return out.select(*[F.col(f"__{c}").alias(c) for c in ("graph", "s", "p", "o")])


def load(spark: SparkSession, folder: str, name: str) -> Store:
    """Registers what ``save`` has written below a folder, in another session or under another name."""
    layout = json.loads(spark.read.text(f"{folder}/layout").first()[0])
    _register_terms(spark, folder, name)
    spark.sql(f"CREATE TABLE {name}_facts (graph bigint, s bigint, o bigint, p bigint) USING parquet PARTITIONED BY (p) CLUSTERED BY (s) SORTED BY (s) INTO {layout['buckets']} BUCKETS LOCATION '{_quoted(folder)}/facts'")
    spark.sql(f"ALTER TABLE {name}_facts RECOVER PARTITIONS")
    return Store(spark, name)


def drop(store: Store) -> None:
    """Forgets the tables; the files stay."""
    for t in ("terms", "facts"):
        store.spark.sql(f"DROP TABLE IF EXISTS {store.name}_{t}")


def numbers(store: Store, wanted: list[tuple[str, str, str | None, str | None]]) -> dict[tuple, int | None]:
    """The numbers of a query's own terms, null for those that the store lacks: one look into the dictionary for all."""
    wanted = list(dict.fromkeys(wanted))
    if not wanted:
        return {}
    asked = store.spark.createDataFrame(wanted, ", ".join(f"{p} string" for p in PARTS))
    told = store.terms.join(F.broadcast(asked), [F.col(f"{store.name}_terms.{p}").eqNullSafe(asked[p]) for p in PARTS], "left_semi")
    found = {tuple(r[p] for p in PARTS): r["id"] for r in told.collect()}
    return {w: found.get(w) for w in wanted}


def _constant(x, place: str) -> tuple | None:
    if isinstance(x, Var) or x is None:
        return None
    if isinstance(x, Literal):
        return ("literal", x.value, x.datatype, x.language)
    return ("uri", RDF_TYPE if x == "a" and place == "p" else x, None, None)


def bgp(store: Store, triples: list[tuple]) -> DataFrame:
    """The solutions of triple patterns in the default graph, as numbers; what a pattern may hold is as in ``patterns.bgp``.

    Patterns with the same subject are joined first, so that their buckets need no shuffle.
    """
    known = numbers(store, [c for t in triples for x, place in zip(t, "spo") if (c := _constant(x, place))])

    def solutions(t: tuple) -> DataFrame:
        rows, found = store.facts.where(F.col("graph").isNull()), {}
        for x, place in zip(t, "spo"):
            if isinstance(x, Var):
                found.setdefault(str(x), []).append(F.col(place))
            else:
                n = known[_constant(x, place)]
                rows = rows.where(F.lit(False) if n is None else F.col(place) == n)
        for same in found.values():
            for other in same[1:]:
                rows = rows.where(same[0] == other)
        return rows.select(*[c[0].alias(v) for v, c in found.items()]) if found else rows.select(F.lit(True).alias("_"))

    stars: dict[object, list[tuple]] = {}
    for t in triples:
        stars.setdefault(t[0], []).append(t)
    joined = []
    for star in stars.values():
        star = sorted(star, key=lambda t: sum(isinstance(x, Var) for x in t))
        out = solutions(star[0])
        for t in star[1:]:
            out = join(out, solutions(t))
        joined.append(out)
    out = joined.pop(0)
    while joined:
        linked = [x for x in joined if set(x.columns) & set(out.columns)] or joined
        joined = [x for x in joined if x is not linked[0]]
        out = join(out, linked[0])
    return out.drop("_")


def named(store: Store, solutions: DataFrame, *variables: str) -> DataFrame:
    """Solutions with the terms (``terms.TERM``) of the named variables, or of all of them, in place of numbers."""
    out = solutions
    for v in variables or tuple(solutions.columns):
        told = store.terms.select(F.col("id").alias("__id"), terms.term(F.col("kind"), F.col("value"), F.col("dt"), F.col("lang")).alias("__term"))
        out = out.join(told, F.col(v) == F.col("__id"), "left").withColumn(v, F.col("__term")).drop("__id", "__term")
    return out


def statements(store: Store) -> DataFrame:
    """The whole table as statements again, in the columns of ``quads.SCHEMA``, without their documents."""
    out = store.facts
    for c in ("graph", "s", "p", "o"):
        told = store.terms.select(F.col("id").alias("__id"), F.struct(*PARTS).alias(f"__{c}"))
        out = out.join(told, F.col(c) == F.col("__id"), "left").drop("__id")
    return out.select(
        F.col("__graph.value").alias("graph"), F.col("__s.value").alias("s"), F.col("__s.kind").alias("s_kind"), F.col("__p.value").alias("p"), F.col("__o.value").alias("o"), F.col("__o.kind").alias("o_kind"),
        F.col("__o.dt").alias("o_dt"), F.col("__o.lang").alias("o_lang"), F.lit(None).cast("string").alias("doc_id"),
    )
