"""SimHash near-dedup: exact comparison of fingerprints in tiles.

Each document becomes a 64-bit fingerprint of its word shingles. Comparing all pairs of tiles grows
with the square of the input, so the tiles are cut inside bit blocks: fingerprints within the radius
r share some choice of k out of r + k blocks, for one of the ways to choose them, and are compared
where they do. The number of blocks follows the number of fingerprints, so that the mean group stays
a tile or less. Inside a group the comparison is the tiled exclusive-or with bit counts; tile pairs
with population counts further apart than the radius are skipped. A group above ``tile`` rows, such
as thousands of near copies, is cut into tiles by population count and salt, and each pair of tiles
is a task's group of its own. No pair of documents is ever emitted: each group gives one link for
each row that is not the first of its component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm import sketch
from attestry.llm.common import checkpoint, distinct, mix, sorted_groups, table, text_buffer, whole_groups
from attestry.llm.components import connected_components
from attestry.llm.tiles import Forest, link, link_sets, link_wide

#: Fixed values of the contract: words of a shingle, seed of XXH64, differing bits of a link.
SHINGLE, SEED, RADIUS = 4, 42, 4


def shingle_hashes(text: bytes, words: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; of all words, where these are fewer."""
    told = text.lower().split()  # bytes: A-Z and white space from tab to carriage return only
    if not told:
        return np.zeros(0, np.uint64)
    flat = b" ".join(told)
    if len(told) <= words:
        return np.array([xxhash.xxh64_intdigest(flat, seed)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))[: len(told) - words + 1].tolist()
    ends = np.concatenate((gaps, [len(flat)]))[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], seed) for a, b in zip(starts, ends)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half the hashes; of none: zero."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text, as an unsigned number; no words: zero."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(text: Column, words: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint as a signed long; null and texts without words: zero."""

    @F.arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        raw, at = text_buffer(column)
        held = raw.tobytes()
        return pa.array(np.array([fingerprint(held[a:b], words, seed) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64).view(np.int64))

    return of(text)


def _blocks(rows: int, radius: int, tile: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The masks to compare under, as lists of (shift, width); more blocks for more rows.

    At most four blocks are kept, of eight at the contract's radius: 70 masks of 32 bits, under which a group is a tile or less up to some
    2 ** 44 fingerprints. More would only make larger groups, which are cut into tiles like any other.
    """
    kept = 1
    while rows / 2 ** (64 * kept // (radius + kept)) > tile and kept < 4:
        kept += 1
    parts = radius + kept
    edges = [64 * i // parts for i in range(parts + 1)]
    cuts = [(edges[i], edges[i + 1] - edges[i]) for i in range(parts)]
    assert comb(parts, kept) == len(list(combinations(cuts, kept)))
    return [(n, list(c)) for n, c in enumerate(combinations(cuts, kept))]


def near_links(prints: DataFrame, radius: int = RADIUS, tile: int = 4096) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints (column ``fp``) that connect all near ones."""
    masks = _blocks(prints.count(), radius, tile)

    def part(cuts: list[tuple[int, int]]) -> Column:
        value, width = F.lit(0).cast("long"), 0
        for shift, bits in cuts:
            got = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))
            value, width = value.bitwiseOR(F.shiftleft(got, width)), width + bits
        return value

    keys = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), part(c).alias("value")) for n, c in masks]))
    rows = prints.select("fp", F.bit_count("fp").alias("ones"), keys.alias("key")).select("fp", "ones", "key.*")
    sizes = rows.groupBy("band", "value", "ones").count()
    whole = sizes.groupBy("band", "value").agg(F.sum("count").alias("n"), F.collect_list(F.struct("ones", F.ceil(F.col("count") / tile).alias("salts"))).alias("cells"))
    shared = whole.where("n > 1").select("band", "value", F.when(F.col("n") > tile, F.col("cells")).alias("cells"))
    salted = rows.join(shared, ["band", "value"]).withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(1 << 20)))
    # of a large group: this row's tile, and every tile within the radius, as pairs in one order
    own = "element_at(filter(cells, c -> c.ones = ones), 1).salts"
    mine = f"struct(ones as p, salt % {own} as s)"
    pairs = f"""CASE WHEN cells IS NULL THEN array(struct(struct(0 as p, 0L as s) as x, struct(0 as p, 0L as s) as y))
      ELSE flatten(transform(filter(cells, c -> abs(c.ones - ones) <= {radius}), c -> transform(sequence(0L, c.salts - 1L), k ->
        struct(least({mine}, struct(c.ones as p, k as s)) as x, greatest({mine}, struct(c.ones as p, k as s)) as y)))) END"""
    placed = salted.select("band", "value", F.explode(F.expr(pairs)).alias("pair"), "fp").select("band", "value", F.xxhash64("pair").alias("pair"), "fp")
    keys_of = ["band", "value", "pair"]

    def compare(batches):
        for group in sorted_groups(batches, keys_of):
            if group.num_rows > 1:
                a, b = link(np.unique(group["fp"].to_numpy()).view(np.uint64), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return placed.repartition(*keys_of).sortWithinPartitions(*keys_of).mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row for each input row: doc_id, fp (signed long), fingerprint (hexadecimal), component_id.

    Null texts and texts without words have fingerprint zero and are linked like any other. Rows
    with equal fingerprints are one component; a null id is never the id of a component unless all
    its rows have null ids. An empty table gives an empty result; other columns are not read.
    """
    rows = checkpoint(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), words).alias("fp")))
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    members = connected_components(near_links(prints.select("fp"), radius))
    classes = _classes(rows, prints, "fp", members)
    return classes.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Of the near-duplicate stage: sets of fewer shingles are always candidates where they share a leading member, larger
#: ones by fingerprints within the expected distance and so many deviations. Shingles that so many sets lead with count as frequent.
FEWEST, DEVIATIONS, FREQUENT = 12, 5, 64


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """A fingerprint of 256 bits, from four mixtures of each hash."""
    return np.array([majority(mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))) for k in range(4)], np.uint64)


def shingle_set(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """The different shingle hashes of a text, in order."""
    return distinct(shingle_hashes(text, words, seed))


def sets_of(column: pa.Array, words: int) -> list[np.ndarray]:
    """The set of each text of a column."""
    raw, at = text_buffer(column)
    held = raw.tobytes()
    return [shingle_set(held[a:b], words) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed longs that name a set of shingles: BLAKE2b of its members, 128 bits."""
    first, second = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), "<i8").tolist()
    return first, second


def set_names(sets: list[np.ndarray], bits: int = 64) -> list[pa.Array]:
    """Columns name and check: the halves of each set's name, the first cut to so many bits."""
    halves = np.array([set_name(s) for s in sets], np.int64).reshape(-1, 2)
    return [pa.array(halves[:, 0] >> (64 - bits)), pa.array(halves[:, 1])]


def wide_prints(text: Column, words: int, bits: int = 64) -> Column:
    """A struct of the number of different shingles, the fingerprint's 32 bytes, both halves of the set's name and the upper halves of its members; null: as empty."""

    @F.arrow_udf("n long, wide binary, name long, check long, members binary")
    def of(column: pa.Array) -> pa.Array:
        sets = sets_of(column, words)
        told = [pa.array([len(s) for s in sets], pa.int64()), pa.array([wide_print(s).tobytes() for s in sets], pa.binary()), *set_names(sets, bits), pa.array([(s >> np.uint64(32)).astype("<u4").tobytes() for s in sets], pa.binary())]
        return pa.StructArray.from_arrays(told, ["n", "wide", "name", "check", "members"])

    return of(text)


def bit_share(x: int, y: int, similarity: float) -> float:
    """The share of bits in which fingerprints of x and y shingles differ, at the least overlap that is similar."""
    both = math.ceil(similarity * (x + y) / (1 + similarity) - 1e-9)
    if both > min(x, y):
        return 0.0

    def ones(n: int) -> np.ndarray:
        return np.array([comb(n, k) / 2**n for k in range(n + 1)])

    def over(n: int, held: int) -> float:  # more than half of n bits are set, where ``held`` of the shared ones are
        return float(ones(n - both)[max(0, n // 2 + 1 - held) :].sum())

    told = [(over(x, k), over(y, k)) for k in range(both + 1)]
    return float(sum(p * (a * (1 - b) + b * (1 - a)) for p, (a, b) in zip(ones(both), told)))


def leading(column: pa.Array, similarity: float, frequent: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Members (upper halves) that each set of a column leads with, and the row of each.

    Members are in order of their hashes, frequent ones last: the same order for all sets. Sets that are similar
    share one of those that they lead with, as many as may be missing in the other and one more; halves of
    different members may be equal, which only adds candidates.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) // 4 if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, "<u4", int(at[-1])) if data is not None and at[-1] else np.zeros(0, np.uint32)
    flat, at = flat[at[0] :].astype(np.uint64), at - at[0]
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    if frequent is not None and len(flat):
        flat = flat[np.lexsort((frequent(flat), row))]
    short = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
    kept = np.arange(len(flat)) - at[row] < short[row]
    return flat[kept], row[kept]


def near_pairs(key: np.ndarray, wide: np.ndarray, n: np.ndarray, radius: int, similarity: float, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of equal key, which arrive together, that may be similar: by bits, or because both sets are small.

    They come in lots of ``most`` or a little more, so that crowded keys need no more memory than others.
    """
    small, found = n <= FEWEST / similarity, [(np.zeros(0, np.int64),) * 2]
    for apart in range(1, len(key)):
        same = np.flatnonzero(key[apart:] == key[:-apart])
        if not len(same):
            break
        x, y = same, same + apart
        fits = np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9
        x, y = x[fits], y[fits]
        bits = np.bitwise_count(wide[x] ^ wide[y]).sum(axis=1, dtype=int)
        near = (bits <= radius) | (small[x] & small[y])
        found.append((x[near], y[near]))
        if sum(len(x) for x, _ in found) >= most:
            yield tuple(np.concatenate(z) for z in zip(*found))
            found = found[:1]
    yield tuple(np.concatenate(z) for z in zip(*found))


def _stars(name: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Links from each name that pairs of places connect to the least name that it is connected with: components then need few rounds."""
    names, at = np.unique(name, return_inverse=True)
    forest = Forest(len(names))
    for x, y in pairs:
        forest.join(at[x], at[y])
    top = forest.roots(np.arange(len(names)))
    moved = np.flatnonzero(top != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[top[moved]])], ["a", "b"])


def _wide(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["wide"].to_pylist()), "<u8").reshape(-1, 4)


def radii_for(similarity: float) -> tuple[int, int, int]:
    """Differing bits of the first 64, 128 and all 256 up to which sets may be similar: those of the worst sizes from ``FEWEST`` shingles on, plus ``DEVIATIONS``."""
    share = max(bit_share(x, y, similarity) for x in range(FEWEST, 4 * FEWEST) for y in range(x, int(x / similarity + 1e-9) + 1))
    share = max(share, math.acos(2 * similarity / (1 + similarity)) / math.pi)
    return tuple(math.ceil(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share))) for bits in (64, 128, 256))


def leads(sets: DataFrame, similarity: float, tile: int, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame | None]:
    """Rows (key, name, n, wide and what is carried) of sets for each member that they lead with and another set may lead with too.

    A first pass counts what sets lead with in a sketch, so that frequent members come last; a second one sketches
    what they then lead with, and only members estimated to lead two sets are written down. The second
    table has those where ``tile`` sets or more are estimated; None where there are none.
    """
    spark = sets.sparkSession
    told = int(sets.agg(F.sum(F.col("n") * (1 - similarity) + 1)).first()[0] or 0)
    of = lambda often: lambda b: iter([leading(b["members"], similarity, often)[0]])
    often = spark.sparkContext.broadcast(sketch.build(sets.select("members"), of(None), FREQUENT, sketch.bits_for(told // 64), 1))
    twice, crowds = sketch.build_each(sets.select("members"), lambda b: of(often.value.passes)(b), (2, tile), sketch.bits_for(told // 2))
    crowded = bool(crowds.held.any())
    seen = spark.sparkContext.broadcast((twice, crowds))
    kept_columns = ("name", "n", "wide", *carried)
    schema = ", ".join(["key long", *(f"{c} {sets.schema[c].dataType.simpleString()}" for c in kept_columns)])

    def lead(crowd: bool) -> DataFrame:
        def tell(batches):
            for batch in batches:
                key, row = leading(batch["members"], similarity, often.value.passes)
                twice, crowds = seen.value
                kept = twice.passes(key)
                key, row = key[kept], row[kept]
                if crowded:
                    mine = crowds.passes(key) == crowd
                    key, row = key[mine], row[mine]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(batch[c].take(take) for c in kept_columns)], ["key", *kept_columns])

        return sets.select(*kept_columns, "members").mapInArrow(tell, schema)

    return lead(False), lead(True) if crowded else None


def similar_links(sets: DataFrame, similarity: float, tile: int = 4096) -> DataFrame:
    """``(a, b)``: links between sets (name, n, wide, members) that connect all with the similarity or more.

    Sets this similar share a member that both lead with (``leading``); only rows that share one are compared, as
    tiles of fingerprints, within ``radii_for`` the similarity. Smaller sets than ``FEWEST`` that share a leading member are linked whatever
    their bits. Members that very many sets lead with are cut into tiles by name, each pair of them a group of its own.
    """
    radii = radii_for(similarity)
    few, crowd = leads(sets, similarity, tile)

    def compare(batches):
        for t in whole_groups(batches, "key"):
            yield _stars(t["name"].to_numpy(), near_pairs(t["key"].to_numpy(), _wide(t), t["n"].to_numpy(), radii[2], similarity))

    def compare_tiles(batches):
        for group in sorted_groups(batches, ["key", "pair"]):
            n, names = group["n"].to_numpy(), group["name"].to_numpy()
            a, b = link_wide(_wide(group), n, group["side"].to_numpy(), radii, similarity)
            small = np.flatnonzero(n <= FEWEST / similarity)
            yield _stars(names, [(np.concatenate((a, small[1:])), np.concatenate((b, small[:1].repeat(max(0, len(small) - 1)))))])

    links = few.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")
    if crowd is None:
        return links
    keyed = checkpoint(crowd.groupBy("key", "name").agg(F.min("n").alias("n"), F.min("wide").alias("wide")))
    parts = keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).alias("parts"))
    cut = keyed.join(parts, "key").select("key", "name", "n", "wide", F.pmod("name", F.col("parts")).alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    placed = cut.select("key", F.xxhash64(F.least("mine", "other"), F.greatest("mine", "other")).alias("pair"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "name", "n", "wide")
    return links.unionByName(placed.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(compare_tiles, "a long, b long"))


def candidate_pairs(sets: DataFrame, similarity: float, tile: int = 4096) -> tuple[DataFrame, DataFrame | None]:
    """``(component, a, b)``: each pair of sets (with component and part) of different parts that ``similar_links`` would link, once for each
    member that both lead with; and the components (None: of none) in which so many sets lead with one member that their pairs are not told."""
    radius = radii_for(similarity)[2]
    few, crowd = leads(sets, similarity, tile, ("component", "part"))

    def tell(batches):
        for t in whole_groups(batches, "key"):
            name, part, component = (t[c].to_numpy() for c in ("name", "part", "component"))
            for x, y in near_pairs(t["key"].to_numpy(), _wide(t), t["n"].to_numpy(), radius, similarity):
                apart = (part[x] != part[y]) & (component[x] == component[y])
                x, y = x[apart], y[apart]
                ends = np.sort(np.stack((name[x], name[y])), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(component[x]), pa.array(ends[0]), pa.array(ends[1])], ["component", "a", "b"])

    pairs = few.repartition("key").sortWithinPartitions("key").mapInArrow(tell, "component long, a long, b long")
    return pairs, None if crowd is None else crowd.select("component").distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, tile: int = 1024, bits: int = 64) -> DataFrame:
    """One row for each input row: doc_id, name and check (of the set of shingles), component_id.

    Documents are linked at ``similarity`` of their word shingles or more. Links by 256 bits between sets that share a
    leading member make up groups of what may be similar; inside a group, sets of shingles are compared exactly.
    Null and empty texts are alike. Equal sets are one component; nulls as in ``near_duplicates``.

    Sets are equal where all 128 bits of their names are. One half (of ``bits`` bits) stands for a set in links; sets that
    share that half only stand under a hash of both.
    """
    text = F.col(text_col)
    rows = table(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text"), wide_prints(text, words, bits).alias("p")).select("doc_id", "text", "p.*"), "similar-sets")
    prints = checkpoint(rows.groupBy("name", "check").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("text").alias("text")))
    shared = checkpoint(prints.groupBy("name").count().where("count > 1").select("name", F.lit(1).alias("shared")))
    if shared.isEmpty():
        rows, prints = (t.withColumn("node", F.col("name")) for t in (rows, prints))
    else:
        node = F.when(F.col("shared") == 1, F.xxhash64("name", "check")).otherwise(F.col("name"))
        rows, prints = (t.join(shared, "name", "left").withColumn("node", node).drop("shared") for t in (rows, prints))
    sets = rows.select(F.col("node").alias("name"), "n", "wide", "members")
    groups = connected_components(similar_links(sets, similarity))
    links = _verified(docs.select(F.xxhash64(text).alias("key"), text.alias("text")), prints, groups, sets, words, similarity, tile, bits)
    told = _classes(rows.select("doc_id", "name", "check", F.col("node").alias("set")), prints.select(F.col("node").alias("set"), "least"), "set", connected_components(links))
    return told.drop("set")


def _verified(docs: DataFrame, prints: DataFrame, groups: DataFrame, candidates: DataFrame, words: int, similarity: float, tile: int, bits: int, most: int = 1 << 20) -> DataFrame:
    """``(a, b)``: links that connect all sets of a group with the similarity or more.

    A group above ``tile`` sets or ``most`` shingles is cut by name. First each of its tiles is compared with itself, where it is the only
    one, or with the first tile: work in proportion to the group, after which most groups of near copies hang together and are done.
    In those that do not, sets of different parts are compared: the pairs that are candidates, where these are fewer than what all pairs of
    tiles would move, and else all pairs of tiles, each a task's group of its own. Only sets that are compared are made
    again and travel: a sketch of their texts' keys picks them.
    """
    sizes = F.ceil(F.greatest(F.count("*") / tile, F.sum("n") / most))
    members = checkpoint(prints.join(groups, "node").select("node", "name", "check", "n", "text", "component"))
    parts = members.groupBy("component").agg(sizes.alias("parts"), F.count("*").alias("sets")).where("parts > 1")
    members = members.join(parts, "component", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))

    def made(members: DataFrame) -> DataFrame:
        """The sets of members and a few others, as (name, check, set)."""
        maybe = docs.sparkSession.sparkContext.broadcast(sketch.of_longs(members, "text", sketch.bits_for(members.count())))

        def pick(batches):
            for batch in batches:
                kept = pa.array(np.flatnonzero(maybe.value.passes(batch["key"].to_numpy().view(np.uint64))))
                sets = sets_of(batch["text"].take(kept), words)
                yield pa.RecordBatch.from_arrays([*set_names(sets, bits), pa.array([s.tobytes() for s in sets], pa.binary())], ["name", "check", "set"])

        return docs.mapInArrow(pick, "name long, check long, set binary").groupBy("name", "check").agg(F.min("set").alias("set"))

    def compare(batches):
        for group in sorted_groups(batches, ["pair"]):
            if group.num_rows > 1:
                held = [np.frombuffer(s.as_buffer(), np.uint64) for s in group["set"]]
                a, b = link_sets(np.concatenate(held), np.array([len(s) for s in held]), group["side"].to_numpy(), similarity)
                yield _stars(group["node"].to_numpy(), [(a, b)])

    def by_tiles(members: DataFrame, others: str) -> DataFrame:
        cut = members.select("node", "name", "check", "component", "parts", F.expr("pmod(node, parts)").alias("mine"))
        cut = cut.select("node", "name", "check", "component", "mine", F.explode(F.expr(others)).alias("other"))
        spread = cut.select("node", "name", "check", F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other")).alias("pair"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
        placed = spread.join(made(members), ["name", "check"]).select("pair", "side", "node", "set")
        return placed.repartition("pair").sortWithinPartitions("pair").mapInArrow(compare, "a long, b long")

    first = by_tiles(members, "if(mine = 0, sequence(0L, parts - 1), array(0L))")
    large = members.where("parts > 1")
    if large.isEmpty():
        return first
    first = checkpoint(first)
    inside = connected_components(first.join(large.select(F.col("node").alias("a")), "a", "left_semi")).withColumnRenamed("component", "part")
    large = checkpoint(large.join(inside, "node", "left").withColumn("part", F.coalesce("part", "node")))
    split = large.groupBy("component").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("component")
    large = checkpoint(large.join(split, "component", "left_semi"))
    if large.isEmpty():
        return first
    sets = candidates.join(large.select(F.col("node").alias("name"), "component", "part"), "name")
    sets = table(sets.groupBy("name", "component", "part").agg(*(F.min(c).alias(c) for c in ("n", "wide", "members"))), "open-sets")
    pairs, crowded = candidate_pairs(sets, similarity)
    told = pairs.groupBy("component").agg(F.count("*").alias("pairs"))
    dear = large.select("component", "sets", "parts").distinct().join(told, "component", "left").where("pairs > sets * parts").select("component")
    dear = checkpoint(dear if crowded is None else dear.unionByName(crowded).distinct())
    few = checkpoint(pairs.join(dear, "component", "left_anti").select("a", "b").distinct())
    ends = few.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    compared = large.join(ends, "node", "left_semi")
    held = table(compared.select("node", "name", "check").join(made(compared), ["name", "check"]).select("node", "set"), "open-members")
    both = few.join(held.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")

    def verify(batches):
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch["x"], batch["y"])):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                near[k] = shared >= similarity * (len(x) + len(y) - shared) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(near))

    links = first.unionByName(both.mapInArrow(verify, "a long, b long"))
    rest = large.join(dear, "component", "left_semi")
    return links if dear.isEmpty() else links.unionByName(by_tiles(rest, "if(mine = 0, array(), sequence(1L, parts - 1))"))


def _classes(rows: DataFrame, prints: DataFrame, name: str, members: DataFrame) -> DataFrame:
    told = prints.join(members, prints[name] == members["node"], "left").select(name, "least", F.coalesce("component", name).alias("component"))
    ids = told.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(told.join(ids, "component").select(name, "component_id"), name)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, tile: int = 1024, bits: int = 64) -> DataFrame:
    """One row of each component of similar documents, that with the smallest id, with all columns.

    Of rows that share that id, one stays; of components without any id, one row stays.
    """
    rows = similar_documents(docs, id_col, text_col, words, similarity, tile, bits)
    least = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = checkpoint(least.groupBy("component_id", F.col("doc_id").alias("i")).agg(F.min(F.struct("name", "check")).alias("p"), F.count("*").alias("n")))
    several = not kept.where("n > 1 or i is null").limit(1).isEmpty()
    whole = docs.select(F.struct("*").alias("whole"), F.col(id_col).alias("doc_id"))
    if not several:
        return whole.join(kept.select("i"), F.col("doc_id") == F.col("i"), "left_semi").select("whole.*")
    named = docs.select(F.struct("*").alias("whole"), F.col(id_col).alias("doc_id"), wide_prints(F.col(text_col), words, bits).alias("p"))
    named = named.select("whole", "doc_id", "p.name", "p.check")
    same = (F.col("name") == F.col("p.name")) & (F.col("check") == F.col("p.check"))
    stay = named.join(kept, F.col("doc_id").eqNullSafe(F.col("i")) & same, "left_semi")
    return stay.groupBy("doc_id", "name", "check").agg(F.first("whole").alias("whole")).select("whole.*")


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("fp")
