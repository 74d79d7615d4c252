"""Version chains: verdicts on links, walks from head to genesis, and what is found along them.

A manifest is a row with manifest_hash, id, version_n, branch and a nullable struct ``chain`` of
previous, previous_branch, genesis_hash and depth. Every link is judged once, by a self-join. What holds
along a chain is folded into each of its manifests by pointer jumping: a round joins every manifest that is not
yet done with the one that its pointer leads to, and takes over what that one knows, so that a chain of
a million links takes twenty rounds and no round has more rows than there are manifests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.plans.durable import cut


def genesis_valid(version: Column, chain: Column) -> Column:
    """A version above 1 must have a chain."""
    return ~((version > 1) & chain.isNull())


def link_reason(cur: str = "cur", prev: str = "prev") -> Column:
    """The first rule that a link breaks, or null: two aliased manifests, the later and the earlier."""
    c, p = (lambda n: F.col(f"{cur}.{n}")), (lambda n: F.col(f"{prev}.{n}"))
    inherited = F.coalesce(p("chain.genesis_hash"), p("manifest_hash"))
    return (
        F.when(c("chain").isNull(), "no chain")
        .when(p("manifest_hash").isNull(), "previous not found")
        .when(c("id") != p("id"), "id")
        .when(~(c("version_n") > p("version_n")), "version")
        .when(c("chain.previous") != p("manifest_hash"), "previous hash")
        .when(~c("chain.genesis_hash").eqNullSafe(inherited), "genesis hash")
        .when(~c("chain.depth").eqNullSafe(F.coalesce(p("chain.depth"), F.lit(1)) + 1), "depth")
        .when(~c("chain.previous_branch").eqNullSafe(p("branch")), "branch")
    )


def link_verdicts(manifests: DataFrame, reason: Column | None = None) -> DataFrame:
    """manifest_hash, previous, reason for every manifest that has a chain."""
    cur, prev = manifests.where("chain is not null").alias("cur"), manifests.alias("prev")
    both = cur.join(prev, F.col("cur.chain.previous") == F.col("prev.manifest_hash"), "left")
    return both.select("cur.manifest_hash", F.col("cur.chain.previous").alias("previous"), (link_reason() if reason is None else reason).alias("reason"))


def heads(manifests: DataFrame) -> DataFrame:
    """The greatest version of each id; of equal versions the first in order of the hash."""
    order = Window.partitionBy("id").orderBy(F.desc("version_n"), "manifest_hash")
    return manifests.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")


def fold(nodes: DataFrame, most: int = 40) -> DataFrame:
    """manifest_hash, depth, first, marks: what each manifest's way to its genesis holds.

    ``nodes`` has manifest_hash, previous, failure (string, null where it holds) and marks (array of
    strings). depth counts the manifests on the way, ``first`` is (depth, failure) of the failure nearest to
    the manifest, ``marks`` (depth, mark, n) of each different mark, the nearest first: its size follows from the kinds
    of marks, not from the chain. A previous manifest that is not among the nodes ends the way. A circle
    would not end; that raises after ``most`` rounds.
    """
    first = F.when(F.col("failure").isNotNull(), F.struct(F.lit(1).cast("long").alias("depth"), "failure"))
    own = F.filter(F.coalesce("marks", F.array().cast("array<string>")), lambda m: m.isNotNull())
    marks = F.transform(F.array_distinct(own), lambda m: F.struct(F.lit(1).cast("long").alias("depth"), m.alias("mark"), F.size(F.filter(own, lambda x: x == m)).cast("long").alias("n")))
    told = nodes.dropDuplicates(["manifest_hash"]).select("manifest_hash", "previous", F.lit(1).cast("long").alias("depth"), first.alias("first"), marks.alias("marks"))
    known = told.select(F.col("manifest_hash").alias("next"))
    state = cut(told.join(known, F.col("previous") == F.col("next"), "left").drop("previous"))
    for _ in range(most):
        ahead = state.where("next is not null")
        if ahead.isEmpty():
            return state.drop("next")
        mine, on = ahead.alias("mine"), state.alias("on")
        both = mine.join(on, F.col("mine.next") == F.col("on.manifest_hash"))
        way = F.col("mine.depth")
        later = F.when(F.col("on.first").isNotNull(), F.struct((F.col("on.first.depth") + way).alias("depth"), F.col("on.first.failure").alias("failure")))
        joined = both.select(
            "mine.manifest_hash", (way + F.col("on.depth")).alias("depth"), F.coalesce(F.col("mine.first"), later).alias("first"),
            F.when(F.size("on.marks") == 0, F.col("mine.marks")).otherwise(_together(F.col("mine.marks"), F.col("on.marks"), way)).alias("marks"), F.col("on.next").alias("next"),
        )
        state = cut(state.where("next is null").unionByName(joined))
    raise RuntimeError(f"a chain does not end within {most} rounds")


def _together(near: Column, far: Column, way: Column) -> Column:
    """The marks of a stretch of ``way`` manifests and of what comes behind it."""
    kept = F.transform(near, lambda m: F.struct(m["depth"].alias("depth"), m["mark"].alias("mark"), (m["n"] + F.aggregate(far, F.lit(0).cast("long"), lambda n, x: n + F.when(x["mark"] == m["mark"], x["n"]).otherwise(0))).alias("n")))
    new = F.filter(far, lambda x: ~F.exists(near, lambda m: m["mark"] == x["mark"]))
    return F.concat(kept, F.transform(new, lambda x: F.struct((x["depth"] + way).alias("depth"), x["mark"].alias("mark"), x["n"].alias("n"))))


def reach(starts: DataFrame, links: DataFrame, most: int = 40) -> DataFrame:
    """manifest_hash: the starts and all manifests on their ways, each once.

    ``links`` has manifest_hash and previous. In every round what is reached takes a step of double length;
    only as many rows as there are manifests are ever held, however many starts share a way, and of
    the links only those that still lead somewhere.
    """
    jump = cut(links.where("previous is not null").select(F.col("manifest_hash").alias("a"), F.col("previous").alias("b")).distinct())
    seen = cut(starts.select("manifest_hash").distinct())
    for _ in range(most):
        if jump.isEmpty():
            return seen
        further = seen.join(jump, F.col("manifest_hash") == F.col("a")).select(F.col("b").alias("manifest_hash"))
        seen = cut(seen.unionByName(further).distinct())
        jump = cut(jump.alias("x").join(jump.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b"))
    raise RuntimeError(f"a chain does not end within {most} rounds")


def passed(starts: DataFrame, nodes: DataFrame, mark: str, most: int = 40) -> DataFrame:
    """head and the ``manifest_hash`` of every marked manifest on the way from each start: as many rows as the answer has.

    ``nodes`` has manifest_hash, previous and a boolean ``mark``. Pointers first jump over all that is not
    marked; then each start steps from one marked manifest to the next.
    """
    told = nodes.select("manifest_hash", "previous", F.coalesce(F.col(mark), F.lit(False)).alias("marked")).dropDuplicates(["manifest_hash"])
    known = told.select(F.col("manifest_hash").alias("next"))
    # ``next``: where the way goes on, as long as no marked manifest is found; ``found``: the nearest marked one, oneself included.
    base = cut(told.join(known, F.col("previous") == F.col("next"), "left").drop("previous"))
    state = cut(base.select("manifest_hash", F.when(F.col("marked"), F.col("manifest_hash")).alias("found"), F.when(~F.col("marked"), F.col("next")).alias("next")))
    for _ in range(most):
        ahead = state.where("next is not null")
        if ahead.isEmpty():
            break
        both = ahead.alias("mine").join(state.alias("on"), F.col("mine.next") == F.col("on.manifest_hash"))
        state = cut(state.where("next is null").unionByName(both.select("mine.manifest_hash", "on.found", "on.next")))
    else:
        raise RuntimeError(f"a chain does not end within {most} rounds")
    found = state.where("found is not null").select(F.col("manifest_hash").alias("at"), "found")
    behind = cut(base.where("marked and next is not null").join(found, F.col("next") == F.col("at")).select(F.col("manifest_hash").alias("a"), F.col("found").alias("b")))
    step = cut(starts.select(F.col("manifest_hash").alias("head")).distinct().join(found, F.col("head") == F.col("at")).select("head", F.col("found").alias("manifest_hash")))
    out = step
    for _ in range(behind.count() + 2):
        if step.isEmpty():
            return out
        step = cut(step.join(behind, F.col("manifest_hash") == F.col("a")).select("head", F.col("b").alias("manifest_hash")))
        out = out.unionByName(step)
    raise RuntimeError("marked manifests make a circle")


def report(manifests: DataFrame, verdicts: DataFrame, key_verdicts: DataFrame | None = None) -> DataFrame:
    """head, valid, depth, reason, failures: one row for each head.

    A structural failure ends a walk: the one nearest to the head is the reason. Key failures
    (manifest_hash, failure) count along the whole way, each kind as (depth, mark, n).
    """
    told = manifests.select("manifest_hash").join(verdicts.select("manifest_hash", "previous", F.col("reason").alias("failure")), "manifest_hash", "left")
    marks = key_verdicts.groupBy("manifest_hash").agg(F.collect_list("failure").alias("marks")) if key_verdicts is not None else None
    told = told.join(marks, "manifest_hash", "left") if marks is not None else told.withColumn("marks", F.lit(None).cast("array<string>"))
    way = heads(manifests).select("manifest_hash").join(fold(told), "manifest_hash")
    return way.select(F.col("manifest_hash").alias("head"), (F.col("first").isNull() & (F.size("marks") == 0)).alias("valid"), "depth", F.col("first.failure").alias("reason"), F.col("marks").alias("failures"))


def transitions(manifests: DataFrame, mode: str = "mode") -> DataFrame:
    """id, version_n, from_mode, to_mode where the mode changes along the versions of an id."""
    order = Window.partitionBy("id").orderBy("version_n")
    told = manifests.withColumn("from_mode", F.lag(mode).over(order))
    return told.where(F.col("from_mode") != F.col(mode)).select("id", "version_n", "from_mode", F.col(mode).alias("to_mode"))


def same_plaintext(manifests: DataFrame, logical: str = "logical_hash") -> DataFrame:
    """Per id, whether all versions are about the same plaintext."""
    return manifests.groupBy("id").agg((F.count_distinct(logical) <= 1).alias("same"), F.count("*").alias("versions"))


def delta_verdict(applied: Column, matches: Column, fallback: Column) -> Column:
    """``valid``, ``warning`` or ``invalid``; null where there was nothing to check.

    ``applied`` is whether the delta and the content before it were found, ``matches`` whether it gives
    the current content, ``fallback`` whether the current content has its address (null: not found).
    """
    return F.when(applied & matches, "valid").when(applied & fallback, "warning").when(applied & ~fallback, "invalid")


def coupling_reason(profile: Column, delta_format: Column) -> Column:
    """Why a delta's format does not go with the manifest's canonical form."""
    return F.when((profile == "JCS") & (delta_format != "application/json-patch+json"), "JCS needs a JSON patch").when((profile == "URDNA2015") & (delta_format != "application/rdf-patch"), "URDNA2015 needs an RDF patch")


def all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests)
