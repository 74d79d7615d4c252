"""Canonical N-Quads of whole tables of documents, after RDF dataset canonicalisation.

Hashing every blank node by the statements that mention it, and naming those whose hash is theirs
alone, are aggregations and a window over all documents at once. Only documents in which two blank
nodes have equal hashes go on to the comparison of paths, a group for each such document.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators.quads import LINE, malformed, normal
from attestry.plans.durable import cut

#: The default limits on blank nodes of a document and on steps of comparing paths.
MOST_NODES, MOST_STEPS = 1000, 20_000
ENDS = ("s", "o", "g")


def tokens(quads: DataFrame) -> DataFrame:
    """doc_id, s, p, o, g: the parts of each statement line, escaped in one way; g is empty in the default graph."""
    parts = [normal(F.regexp_extract("quad", LINE, k + 1)).alias(n) for k, n in enumerate(("s", "p", "o", "g"))]
    return quads.where(F.col("quad").rlike(LINE)).select("doc_id", *parts).distinct()


def _line(s: Column, p: Column, o: Column, g: Column) -> Column:
    return F.concat_ws(" ", s, p, o, F.nullif(g, F.lit("")), F.lit("."))


def mentions(rows: DataFrame) -> DataFrame:
    """doc_id, node, s, p, o, g: each statement under each blank node in it."""
    nodes = F.array_distinct(F.filter(F.array(*ENDS), lambda x: F.startswith(x, F.lit("_:"))))
    return rows.select("doc_id", F.explode(nodes).alias("node"), "s", "p", "o", "g")


def first_hashes(rows: DataFrame) -> DataFrame:
    """doc_id, node, hash: the digest of a node's statements, itself as ``_:a`` and others as ``_:z``."""

    def seen(c: str) -> Column:
        return F.when(F.col(c) == F.col("node"), "_:a").when(F.startswith(c, F.lit("_:")), "_:z").otherwise(F.col(c))

    told = mentions(rows).select("doc_id", "node", F.concat(_line(seen("s"), F.col("p"), seen("o"), seen("g")), F.lit("\n")).alias("line"))
    return told.groupBy("doc_id", "node").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ""), 256).alias("hash"))


class Names:
    """Names given in order of asking."""

    def __init__(self, prefix: str, given: dict[str, str] | None = None) -> None:
        self.prefix, self.given = prefix, dict(given or {})

    def name(self, node: str) -> str:
        return self.given.setdefault(node, f"{self.prefix}{len(self.given)}")

    def copy(self) -> Names:
        return Names(self.prefix, self.given)


class _Paths:
    """Naming the blank nodes of one document whose hashes are not theirs alone."""

    def __init__(self, statements: list[tuple[str, str, str, str]], hashes: dict[str, str], canonical: Names, most: int) -> None:
        self.hashes, self.canonical, self.left = hashes, canonical, most
        self.near: dict[str, list[tuple[str, str, str]]] = {n: [] for n in hashes}  # other node, position, predicate
        for s, p, o, g in statements:
            ends = list(zip((s, o, g), "sog"))
            for node in {x for x, _ in ends if x in hashes}:
                self.near[node] += [(x, place, p) for x, place in ends if x in hashes and x != node]

    def label(self, other: str, place: str, predicate: str, names: Names) -> str:
        own = self.canonical.given.get(other) or names.given.get(other)
        told = place + (predicate if place != "g" else "") + (f"_:{own}" if own else self.hashes[other])
        return hashlib.sha256(told.encode()).hexdigest()

    def walk(self, node: str, names: Names) -> tuple[str, Names]:
        groups: dict[str, list[str]] = {}
        for other, place, predicate in self.near[node]:
            groups.setdefault(self.label(other, place, predicate, names), []).append(other)
        data = ""
        for key in sorted(groups):
            best: tuple[str, Names] | None = None
            for order in permutations(groups[key]):
                self.left -= 1
                if self.left < 0:
                    raise OverflowError("too many paths between blank nodes")
                now, path, deeper = names.copy(), "", []
                for other in order:
                    if other not in self.canonical.given and other not in now.given:
                        deeper.append(other)
                    path += "_:" + (self.canonical.given.get(other) or now.name(other))
                for other in deeper:
                    if best and len(path) >= len(best[0]) and path > best[0]:
                        break
                    told, after = self.walk(other, now)
                    path, now = f"{path}_:{now.name(other)}<{told}>", after
                if best is None or path < best[0]:
                    best = path, now
            assert best
            data, names = data + key + best[0], best[1]
        return hashlib.sha256(data.encode()).hexdigest(), names

    def run(self) -> None:
        tied: dict[str, list[str]] = {}
        for node, h in self.hashes.items():
            if node not in self.canonical.given:
                tied.setdefault(h, []).append(node)
        for h in sorted(tied):
            found = []
            for node in sorted(tied[h]):
                if node not in self.canonical.given:
                    names = Names("b")
                    names.name(node)
                    found.append(self.walk(node, names))
            for _, names in sorted(found, key=lambda x: x[0]):
                for node in names.given:
                    self.canonical.name(node)


def name_nodes(rows: DataFrame, most_nodes: int = MOST_NODES, most_steps: int = MOST_STEPS) -> DataFrame:
    """doc_id, node, name, error: the canonical name of every blank node, or why its document has none."""
    hashes = cut(first_hashes(rows))
    per_hash, per_doc = Window.partitionBy("doc_id", "hash"), Window.partitionBy("doc_id")
    told = hashes.withColumn("same", F.count("*").over(per_hash)).withColumn("nodes", F.count("*").over(per_doc))
    told = cut(told.withColumn("tied", F.max(F.col("same") > 1).over(per_doc)))
    none = F.lit(None).cast("string")
    over = told.where(F.col("nodes") > most_nodes).select("doc_id", "node", none.alias("name"), F.lit("too many blank nodes").alias("error"))
    fits = told.where(F.col("nodes") <= most_nodes)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("hash")) - 1
    plain = fits.where("not tied").select("doc_id", "node", F.concat(F.lit("c14n"), place.cast("string")).alias("name"), none.alias("error"))
    hard = fits.where("tied")

    def settle(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(left["node"], left["hash"]))
        canonical = Names("c14n")
        for node in left[left["same"] == 1].sort_values("hash")["node"]:
            canonical.name(node)
        error = None
        try:
            _Paths(list(right[["s", "p", "o", "g"]].itertuples(index=False, name=None)), known, canonical, most_steps).run()
        except (OverflowError, RecursionError) as e:
            error, canonical = str(e), Names("c14n")
        return pd.DataFrame({"doc_id": left["doc_id"], "node": left["node"], "name": [canonical.given.get(n) for n in left["node"]], "error": error})

    kind = rows.schema["doc_id"].dataType.simpleString()
    theirs = rows.join(hard.select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), "s", "p", "o", "g")
    compared = hard.groupBy("doc_id").cogroup(theirs.groupBy("doc"))
    return plain.unionByName(over).unionByName(compared.applyInPandas(settle, f"doc_id {kind}, node string, name string, error string"))


def canonicalise(quads: DataFrame, most_nodes: int = MOST_NODES, most_steps: int = MOST_STEPS) -> DataFrame:
    """doc_id, text, error: canonical N-Quads of every document of ``(doc_id, quad)`` lines.

    Lines are sorted and each ends with a line feed. A document above a limit, or with a line that is no
    statement, has the error and no text.
    """
    rows = cut(tokens(quads))
    names = name_nodes(rows, most_nodes, most_steps)
    broken = malformed(quads).select("doc_id", F.lit("malformed statement").alias("error"))
    failed = names.where("error is not null").select("doc_id", "error").unionByName(broken).groupBy("doc_id").agg(F.min("error").alias("error"))
    known = names.where("error is null").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("node", "name"))).alias("names"))

    def shown(c: str) -> Column:
        return F.when(F.startswith(c, F.lit("_:")), F.concat(F.lit("_:"), F.try_element_at("names", F.col(c)))).otherwise(F.col(c))

    told = rows.join(known, "doc_id", "left").select("doc_id", _line(shown("s"), F.col("p"), shown("o"), shown("g")).alias("line"))
    texts = told.groupBy("doc_id").agg(F.concat(F.array_join(F.array_sort(F.collect_set("line")), "\n"), F.lit("\n")).alias("text"))
    return texts.join(failed, "doc_id", "full").select("doc_id", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error")
