"""Graph queries as DataFrame operations: patterns, joins of solutions, paths and their results.

A query is written with these functions, not parsed from text. Solutions are DataFrames with a term
column for each variable. Patterns become filters and equi-joins, so pruning, join order and join
strategy are left to the optimiser.

A variable that optional parts, unions or inline data leave unbound in some solutions is marked so in
its column's metadata. Solutions are compatible where such a variable is unbound on either side; each
side is then split by which of these are bound, and each pair of parts is joined on what both bind, so
no join compares all solutions with all others unless they share nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import terms
from attestry.operators.quads import RDF_TYPE
from attestry.plans.durable import cut


class Var(str):
    """The name of a variable."""


class Literal:
    """A constant literal of a pattern."""

    def __init__(self, value: str, datatype: str | None = None, language: str | None = None) -> None:
        self.value, self.datatype, self.language = value, datatype, language


def pattern(quads: DataFrame, s, p, o, graph: str | Var | None = None) -> DataFrame:
    """The solutions of one triple pattern.

    Strings are addresses (``a`` is the type predicate), ``Var`` a variable, ``Literal`` a literal. Without
    ``graph`` the default graph is searched; a variable binds the named graphs. A variable that occurs
    twice demands equal terms.
    """
    columns = {
        "s": terms.term(F.col("s_kind"), F.col("s")),
        "p": terms.uri(F.col("p")),
        "o": terms.term(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang")),
        "graph": terms.uri(F.col("graph")),
    }
    rows = quads.where(F.col("graph").isNull() if graph is None else F.col("graph").isNotNull() if isinstance(graph, Var) else F.col("graph") == graph)
    found: dict[str, list[Column]] = {}
    for place, wanted in (("s", s), ("p", RDF_TYPE if p == "a" and not isinstance(p, Var) else p), ("o", o), ("graph", graph if isinstance(graph, Var) else None)):
        if isinstance(wanted, Var):
            found.setdefault(str(wanted), []).append(columns[place])
        elif isinstance(wanted, Literal):
            rows = rows.where((F.col("o_kind") == "literal") & (F.col("o") == wanted.value) & F.col("o_dt").eqNullSafe(F.lit(wanted.datatype)) & F.col("o_lang").eqNullSafe(F.lit(wanted.language)))
        elif wanted is not None:
            rows = rows.where(F.col(place) == wanted) if place == "p" or place == "graph" else rows.where((F.col(place) == wanted) & (F.col(f"{place}_kind") == "uri"))
    for same in found.values():
        for other in same[1:]:
            rows = rows.where(same[0] == other)
    return rows.select(*[c[0].alias(v) for v, c in found.items()]) if found else rows.select(F.lit(True).alias("_"))


def shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


_UNBOUND = "unbound"


def may_be_unbound(a: DataFrame, name: str) -> bool:
    """Whether a variable is unbound in some solutions, as far as the operators here know."""
    return bool(a.schema[name].metadata.get(_UNBOUND))


def mark_unbound(a: DataFrame, *names: str) -> DataFrame:
    """Says that the variables may be unbound, for solutions that come from elsewhere."""
    return a.select(*[F.col(c).alias(c, metadata={**a.schema[c].metadata, _UNBOUND: True}) if c in names else F.col(c) for c in a.columns])


def _parts(a: DataFrame, loose: list[str]) -> list[tuple[frozenset[str], DataFrame]]:
    """The solutions by which of the loose variables they bind; the parts are disjoint and leave none out."""
    out = []
    for bound in product((True, False), repeat=len(loose)):
        tests = [F.col(v).isNotNull() if b else F.col(v).isNull() for v, b in zip(loose, bound)]
        out.append((frozenset(v for v, b in zip(loose, bound) if b), a.where(reduce(lambda x, y: x & y, tests)) if tests else a))
    return out


def _pairs(a: DataFrame, b: DataFrame, maybe: tuple[str, ...] | None) -> list[tuple[DataFrame, list[tuple[DataFrame, list[str]]]]]:
    """Each part of a, with the parts of b and the variables that both bind."""
    both = shared(a, b)
    loose_a = [v for v in both if may_be_unbound(a, v) or v in (maybe or ())]
    loose_b = [v for v in both if may_be_unbound(b, v) or v in (maybe or ())]
    out = []
    for bound_a, x in _parts(a, loose_a):
        sure_a = {v for v in both if v not in loose_a} | bound_a
        parts = [(y, [v for v in both if v in sure_a and (v not in loose_b or v in bound_b)]) for bound_b, y in _parts(b, loose_b)]
        out.append((x, parts))
    return out


def join(a: DataFrame, b: DataFrame, maybe: tuple[str, ...] = ()) -> DataFrame:
    """Compatible solutions joined; ``maybe`` names shared variables that may be unbound, beside the marked ones."""
    return reduce(DataFrame.unionByName, [_linked(x, y, keys, None) for x, parts in _pairs(a, b, maybe) for y, keys in parts])


def optional(a: DataFrame, b: DataFrame, maybe: tuple[str, ...] = (), on: Column | None = None) -> DataFrame:
    """All of a, with b where it is compatible (and where ``on`` holds).

    ``on`` names variables of a, and of b those that a lacks.
    """
    out = []
    fresh = {c: b.schema[c].dataType for c in b.columns if c not in a.columns}
    for x, parts in _pairs(a, b, maybe):
        if len(parts) == 1:
            out.append(_linked(x, *parts[0], on, "left"))
            continue
        out += [_linked(x, y, keys, on) for y, keys in parts]
        rest = reduce(lambda left, part: _linked(left, *part, on, "left_anti"), parts, x)
        out.append(rest.select("*", *[F.lit(None).cast(t).alias(c) for c, t in fresh.items()]))
    return mark_unbound(reduce(DataFrame.unionByName, out), *fresh)


def _linked(a: DataFrame, b: DataFrame, keys: list[str], on: Column | None, how: str = "inner") -> DataFrame:
    """a and b joined on ``keys``; of other shared variables, the side that binds it has the term."""
    both = shared(a, b)
    right = b.toDF(*[f"{c}__r" if c in both else c for c in b.columns])
    tests = [F.col(v) == F.col(f"{v}__r") for v in keys] + ([] if on is None else [on])
    if how in ("left_anti", "left_semi"):
        return a.join(right if tests else right.limit(1), reduce(lambda x, y: x & y, tests, F.lit(True)), how)
    out = a.join(right, reduce(lambda x, y: x & y, tests), how) if tests else a.crossJoin(right) if how == "inner" else a.join(right, F.lit(True), how)

    def term(v: str) -> Column:
        if v not in both or v in keys:
            return F.col(v)
        unbound = may_be_unbound(a, v) and may_be_unbound(b, v)
        return F.coalesce(v, f"{v}__r").alias(v, metadata={_UNBOUND: True} if unbound else {})

    return out.select(*[term(v) for v in a.columns], *[c for c in b.columns if c not in both])


def bgp(quads: DataFrame, triples: list[tuple]) -> DataFrame:
    """A basic graph pattern: triple patterns joined on what they share, the most bound ones first."""
    def bound(t: tuple) -> int:
        return sum(not isinstance(x, Var) for x in t)

    rest = sorted(triples, key=bound, reverse=True)
    first = rest.pop(0)
    out, seen = pattern(quads, *first), {x for x in first if isinstance(x, Var)}
    while rest:
        linked = [t for t in rest if seen & {x for x in t if isinstance(x, Var)}] or rest
        t = linked[0]
        rest.remove(t)
        out, seen = join(out, pattern(quads, *t)), seen | {x for x in t if isinstance(x, Var)}
    return out.drop("_")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All solutions of both; variables that one lacks are unbound there."""
    loose = {c for c in {*a.columns, *b.columns} if any(c not in x.columns or may_be_unbound(x, c) for x in (a, b))}
    return mark_unbound(a.unionByName(b, allowMissingColumns=True), *loose)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Solutions of a compatible with none of b that binds a variable which they bind too."""
    if not shared(a, b):
        return a
    out = [reduce(lambda left, part: _linked(left, *part, None, "left_anti") if part[1] else left, parts, x) for x, parts in _pairs(a, b, None)]
    return reduce(DataFrame.unionByName, out)


def exists(a: DataFrame, b: DataFrame) -> DataFrame:
    """Solutions of a that are compatible with one of b."""
    out = []
    for x, parts in _pairs(a, b, None):
        for y, keys in parts:  # each solution once: what a part of b has is not asked of the next
            out.append(_linked(x, y, keys, None, "left_semi"))
            x = _linked(x, y, keys, None, "left_anti")
    return reduce(DataFrame.unionByName, out)


def not_exists(a: DataFrame, b: DataFrame) -> DataFrame:
    """Solutions of a that are compatible with none of b."""
    return reduce(DataFrame.unionByName, [reduce(lambda left, part: _linked(left, *part, None, "left_anti"), parts, x) for x, parts in _pairs(a, b, None)])


def dataset(quads: DataFrame, default: list[str] | None = None, named: list[str] | None = None) -> DataFrame:
    """The statements that a query asks where it names its graphs.

    The graphs of ``default`` are merged into the default graph, each statement once, and only those of
    ``named`` stay named; without either the statements stay as they are.
    """
    if default is None and named is None:
        return quads
    plain = quads.where(F.col("graph").isin(default or [])).withColumn("graph", F.lit(None).cast("string"))
    plain = plain.dropDuplicates([c for c in quads.columns if c not in ("graph", "doc_id")])
    return plain.unionByName(quads.where(F.col("graph").isin(named or [])))


def values(a: DataFrame, names: list[str], rows: list[tuple]) -> DataFrame:
    """Joins inline data, a table of the query's own size; ``None`` is an undefined value.

    Entries are addresses, or ``Literal``.
    """
    kind = ", ".join(f"`{n}` {terms.TERM}" for n in names)

    def one(x):
        return None if x is None else ("literal", x.value, x.datatype, x.language) if isinstance(x, Literal) else ("uri", x, None, None)

    data = a.sparkSession.createDataFrame([tuple(map(one, r)) for r in rows], kind)
    open_ = [n for k, n in enumerate(names) if any(r[k] is None for r in rows)]
    return join(a, F.broadcast(mark_unbound(data, *open_) if open_ else data))


def order_by(a: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """Sorts by variables, each with whether it ascends; terms in the order of ``terms.sort_keys``."""
    columns = []
    for name, up in keys:
        columns += [c.asc_nulls_first() if up else c.desc_nulls_last() for c in terms.sort_keys(F.col(name))]
    return a.orderBy(*columns)


def steps(quads: DataFrame, predicates: list[str], inverse: bool = False, negated: bool = False) -> DataFrame:
    """``(x, y)`` pairs that one step of any of the predicates links; or of any other one."""
    hit = F.col("p").isin(*predicates)
    s, o = terms.term(F.col("s_kind"), F.col("s")), terms.term(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))
    a, b = (o, s) if inverse else (s, o)
    return quads.where(F.col("graph").isNull() & (~hit if negated else hit)).select(a.alias("x"), b.alias("y"))


def sequence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs linked by a step of a and then one of b."""
    return a.join(b.toDF("y", "z"), "y").select("x", F.col("z").alias("y"))


def one_or_more(pairs: DataFrame, most: int = 64) -> DataFrame:
    """The transitive closure of pairs, each once.

    Circles are taken together first (``strong_components``), the graph of what is left has none, and its closure is
    expanded to the members at the end. Raises where ``most`` rounds do not suffice.
    """
    pairs = cut(pairs.distinct())
    if _without_ends(pairs.where("x <> y")).isEmpty():
        loops = pairs.where("x = y")
        return _closure(pairs.where("x <> y"), most).unionByName(loops)
    parts = cut(strong_components(pairs, most))
    return _condensed(pairs, parts, most).join(parts.toDF("x", "cx"), "cx").join(parts.toDF("y", "cy"), "cy").select("x", "y")


def reach_counts(pairs: DataFrame, parts: DataFrame | None = None, most: int = 64) -> DataFrame:
    """x, n: how many terms each leads to in one step or more, itself among them where it lies on a circle.

    As many as ``one_or_more`` has pairs for it, which are not written down: a circle is one component of so many terms. ``parts``
    are the ``strong_components`` of the pairs, where they are known.
    """
    pairs = cut(pairs.distinct())
    parts = cut(strong_components(pairs, most) if parts is None else parts)
    sizes = parts.groupBy(F.col("component").alias("cy")).agg(F.count("*").alias("n"))
    told = _condensed(pairs, parts, most).join(sizes, "cy").groupBy("cx").agg(F.sum("n").alias("n"))
    return told.join(parts.toDF("x", "cx"), "cx").select("x", "n")


def _condensed(pairs: DataFrame, parts: DataFrame, most: int) -> DataFrame:
    """cx, cy: which components lead to which, to themselves where there is a circle in them."""
    placed = cut(pairs.join(parts.toDF("x", "cx"), "x").join(parts.toDF("y", "cy"), "y"))
    between = _closure(placed.where("cx <> cy").select(F.col("cx").alias("x"), F.col("cy").alias("y")).distinct(), most).toDF("cx", "cy")
    return between.unionByName(placed.where("cx = cy").select("cx", F.col("cx").alias("cy")).distinct())


def _closure(pairs: DataFrame, most: int) -> DataFrame:
    """The closure of pairs without circles: what a round has found takes on all that is known, so paths double in length."""
    known = last = cut(pairs)
    for _ in range(most):
        if last.isEmpty():
            return known
        last = cut(sequence(last, known).distinct().join(known, ["x", "y"], "left_anti"))
        known = cut(known.unionByName(last))
    raise RuntimeError(f"no closure after {most} rounds")


def _turned(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))


def _single(pairs: DataFrame) -> DataFrame:
    """The pairs of those x that have just one, not themselves; pairs are told once each."""
    return pairs.groupBy("x").agg(F.min("y").alias("y"), F.count("*").alias("n")).where("n = 1 and x <> y").drop("n")


def shortcuts(pairs: DataFrame, most: int = 40) -> DataFrame:
    """Pairs that lead 2, 4, 8 and so on steps ahead along stretches where there is only one way to go.

    With them a path of n steps is gone in the logarithm of n rounds; there are at most so many for each term.
    """
    jump = cut(_single(pairs))
    n, out, far = jump.count(), None, 1
    for _ in range(most):
        if far >= n or jump.isEmpty():
            break
        jump, far = cut(sequence(jump, jump)), 2 * far
        out = jump if out is None else out.unionByName(jump)
    return jump.where("false") if out is None else out.where("x <> y").distinct()


def _stretch_ends(pairs: DataFrame, most: int = 40) -> DataFrame:
    """x, y: where the single way from x leads to in the end; none for those that it leads into a circle of single ways."""
    single = cut(_single(pairs))
    inner = single.select(F.col("x").alias("y"), F.lit(True).alias("on"))
    state, n, far = cut(single.join(inner, "y", "left").select("x", "y", F.coalesce("on", F.lit(False)).alias("on"))), single.count(), 1
    for _ in range(most):
        if far >= n or state.where("on").isEmpty():
            break
        ahead = state.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("on").alias("further"))
        state = cut(state.where(~F.col("on")).unionByName(state.where("on").join(ahead, "y").select("x", F.col("z").alias("y"), F.col("further").alias("on"))))
        far *= 2
    return state.where(~F.col("on")).select("x", "y")


#: Rounds after which stretches with only one way are worth their shortcuts: short paths need none.
PATIENCE = 4


def _without_ends(pairs: DataFrame, most: int = 10_000) -> DataFrame:
    """The pairs that are left when all that lead to nowhere, or come from nowhere, are taken away; none if there is no circle."""
    left, before = cut(pairs), -1
    for k in range(most):
        n = left.count()
        if n in (0, before):
            return left
        before = n
        from_, to = left.select(F.col("x").alias("y")).distinct(), left.select(F.col("y").alias("x")).distinct()
        now = left.join(from_, "y", "left_semi").join(to, "x", "left_semi")
        if k >= PATIENCE:
            back = _turned(left)
            lost = _stretch_ends(left).join(from_, "y", "left_anti").select("x")  # single ways to an end without a way on
            first = _stretch_ends(back).join(back.select(F.col("x").alias("y")), "y", "left_anti").select(F.col("x").alias("y"))
            now = now.join(lost, "x", "left_anti").join(first, "y", "left_anti")
        left = cut(now.select("x", "y"))
    raise RuntimeError(f"pairs without an end after {most} rounds")


def _spread(pairs: DataFrame, start: DataFrame, most: int, more: Callable[[], DataFrame]) -> DataFrame:
    """x, v: the least ``v`` of a term and of all that lead to it; in each round only what has changed is told on.

    Where that takes long, ``more`` gives the pairs with their shortcuts.
    """
    state = fresh = start
    for k in range(most):
        if k == PATIENCE:
            pairs, fresh = more(), state
        told = fresh.join(pairs, "x").groupBy(F.col("y").alias("x")).agg(F.min("v").alias("w"))
        fresh = cut(told.join(state, "x").where("w < v").select("x", F.col("w").alias("v")))
        if fresh.isEmpty():
            return state
        state = cut(state.join(fresh.withColumnRenamed("v", "w"), "x", "left").select("x", F.coalesce("w", "v").alias("v")))
    raise RuntimeError(f"no rest after {most} rounds")


def strong_components(pairs: DataFrame, most: int = 64, steps: int = 10_000) -> DataFrame:
    """x, component: for each term the least of those that it leads to and that lead back to it, itself included.

    Ends and stretches without a circle go first. Then each term learns the least label that leads to it and the
    least that it leads to, labels being hashes new in each round: where both are the same it belongs to that label's
    component, and pairs whose terms differ in one of them lie in no circle. Shortcuts make long stretches short.
    """
    pairs = cut(pairs.distinct())
    nodes = cut(pairs.select("x").unionByName(pairs.select(F.col("y").alias("x"))).distinct())
    left, done = pairs.where("x <> y"), None
    for k in range(most):
        left = _without_ends(left)
        if left.isEmpty():
            break
        start = cut(left.select("x").distinct().withColumn("v", F.struct(F.xxhash64(F.lit(k), "x").alias("h"), F.col("x").alias("x"))))
        ways = cache(lambda now=left: cut(now.unionByName(shortcuts(now)).unionByName(_turned(shortcuts(_turned(now)))).distinct()))
        ahead, back = _spread(left, start, steps, ways), _spread(_turned(left), start, steps, lambda told=ways: _turned(told()))
        told = cut(ahead.join(back.withColumnRenamed("v", "w"), "x"))
        done_now = told.where("v = w").select("x", F.col("v.h").alias("h"), F.col("v.x").alias("root"))
        least = done_now.groupBy("h", "root").agg(F.min("x").alias("component"))
        here = cut(done_now.join(least, ["h", "root"]).select("x", "component"))
        done = here if done is None else done.unionByName(here)
        rest = told.where("v <> w")
        left = cut(left.join(rest, "x").join(rest.select(F.col("x").alias("y"), F.col("v").alias("v2"), F.col("w").alias("w2")), "y").where("v = v2 and w = w2").select("x", "y"))
    else:
        raise RuntimeError(f"no components after {most} rounds")
    if done is None:
        return nodes.select("x", F.col("x").alias("component"))
    return nodes.join(done, "x", "left").select("x", F.coalesce("component", "x").alias("component"))


def reached(pairs: DataFrame, starts: DataFrame, most: int = 10_000) -> DataFrame:
    """The pairs of the transitive closure that begin at the terms of ``starts`` (column x), each once.

    Only what the starts reach is worked on: in each round the pairs found last take one step more, or a shortcut where there is
    only one way to go. For a path whose end is bound instead, give the inverse pairs. Raises where ``most`` rounds do not suffice.
    """
    pairs = cut(pairs.distinct())
    last = cut(pairs.join(starts.select("x").distinct(), "x", "left_semi"))
    known, ways = last, None
    for k in range(most):
        if last.isEmpty():
            return known
        if k == PATIENCE:
            ways = cut(pairs.unionByName(shortcuts(pairs)).distinct())
        last = cut(sequence(last, pairs if ways is None else ways).distinct().join(known, ["x", "y"], "left_anti"))
        known = cut(known.unionByName(last))
    raise RuntimeError(f"no closure after {most} rounds")


def zero_or_more(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The reflexive closure over the terms of ``nodes`` (column x)."""
    return one_or_more(pairs).unionByName(nodes.select("x", F.col("x").alias("y"))).distinct()


def zero_or_one(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    return pairs.unionByName(nodes.select("x", F.col("x").alias("y"))).distinct()


def ask(a: DataFrame) -> DataFrame:
    """One row: whether there is a solution."""
    return a.limit(1).agg((F.count("*") > 0).alias("answer"))


def construct(a: DataFrame, template: list[tuple]) -> DataFrame:
    """Statements built from solutions; those with an unbound part are left out, each is given once."""

    def part(x) -> Column:
        return F.col(str(x)) if isinstance(x, Var) else terms.literal(x.value, x.datatype, x.language) if isinstance(x, Literal) else terms.uri(x)

    rows = a.select(F.explode(F.array(*[F.struct(part(s).alias("s"), part(p).alias("p"), part(o).alias("o")) for s, p, o in template])).alias("t")).select("t.*")
    return rows.where("s is not null and p.kind = 'uri' and o is not null and s.kind <> 'literal'").distinct()


def describe(quads: DataFrame, a: DataFrame, name: str) -> DataFrame:
    """The statements whose subject is a solution's term."""
    wanted = a.select(F.col(f"{name}.value").alias("s"), F.col(f"{name}.kind").alias("s_kind")).distinct()
    return quads.join(wanted, ["s", "s_kind"], "left_semi")
