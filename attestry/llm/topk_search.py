"""Exact top-k search by inner product with a pivot-distance index.

Inner products become distances: with M the greatest norm, a candidate x gets one more component,
sqrt(M^2 - |x|^2), a query gets zero, and the nearest candidates are those of the greatest product.
Pivots are fitted on a bounded sample; every vector is keyed by its nearest pivot and the distance to
it. Each pivot's rows are cut by distance into annuli of bounded size, an annulus of equal distances by
salt; these are the shards. A query is first searched in the nearest shards that together hold more than
k rows, which bounds its k-th distance. A shard that very many queries ask is copied. Then it goes to those other shards only whose annulus the
triangle inequality leaves open at that distance. Inside a shard only the rows of the open annulus
are multiplied, nearest shards narrowing it further. The best of each shard are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import checkpoint, draw, draws_for, sorted_groups

SCALE, TOP, EVERY = 64, 20, 20  # fixed values of the contract
SLACK = 1e-6  # relative, of squared distances: bounds are floating point, products are exact
BINS = 256  # of the distances to one pivot
INDEXED = 64  # the most frequent dimensions, each with an index of its own


def digitise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(row, vec_id, n, v)`` with v the n components floor(scale * x) as packed 64-bit integers.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an id.
    Rows that share an id are rows of their own, told apart by ``row``. A component that has no
    64-bit integer raises.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, sizes, packed = [], [], [], []
            for r, i, v in zip(batch["row"].to_pylist(), batch["vec_id"].to_pylist(), batch["v"]):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(float)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(scale * x)
                if (np.abs(x) >= 2.0**63).any():
                    raise OverflowError(f"a component of vector {i} has no 64-bit integer")
                rows.append(r), ids.append(i), sizes.append(len(x)), packed.append(x.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], ["row", "vec_id", "n", "v"])

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    return rows.mapInArrow(pack, "row long, vec_id long, n int, v binary")


def unpack(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), width)


def lift(x: np.ndarray, top: float) -> np.ndarray:
    """Candidates with the further component that turns products into distances."""
    x = x.astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))])


def fit_pivots(sample: np.ndarray, pivots: int, rounds: int = 5) -> np.ndarray:
    """Means of the sample's clusters, a few rounds from evenly spread rows."""
    if not len(sample):
        return sample
    centre = sample[np.linspace(0, len(sample) - 1, min(pivots, len(sample))).astype(int)]
    for _ in range(rounds):
        near = distances(sample, centre).argmin(axis=1)
        n = np.bincount(near, minlength=len(centre))
        sums = np.zeros_like(centre)
        np.add.at(sums, near, sample)
        centre = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centre)
    return centre


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of q and x, as Python's integers where 64 bits may not suffice."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**52:
        return np.rint(q.astype(float) @ x.astype(float).T).astype(np.int64)
    if most < 2**62:
        return q @ x.T
    return q.astype(object) @ x.astype(object).T


def shard_bounds(to: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least distance that rows between ``low`` and ``high`` of a pivot can have from a point ``to`` off it."""
    return np.maximum(0.0, np.maximum(to - high, low - to))


def layout(counts: dict[tuple[int, int], int], pivots: int, most: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """For each pivot and bin the first shard and the number of shards, and of each shard pivot, first bin, last bin, rows.

    Neighbouring bins of a pivot share a shard up to ``most`` rows; a bin with more is cut by salt.
    """
    first, cuts, shards = np.zeros((pivots, BINS), np.int64), np.ones((pivots, BINS), np.int64), []
    for c in range(pivots):
        room = 0
        for b in range(BINS):
            n = counts.get((c, b), 0)
            if n > most:
                first[c, b], cuts[c, b], room = len(shards), -(-n // most), 0
                shards += [(c, b, b, n // -(-n // most))] * int(cuts[c, b])
            elif n:
                if n > room:
                    shards.append((c, b, b, 0))
                    room = most
                room -= n
                first[c, b] = len(shards) - 1
                shards[-1] = (c, shards[-1][1], b, shards[-1][3] + n)
    return first, cuts, shards


def best_of(ids: np.ndarray, scores: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, id and score of the k best of each query, in order."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], ids[place < k], scores[place < k]


def kth_of(told: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row, cut to 64 bits."""
    kth = np.partition(told, told.shape[1] - k, axis=1)[:, told.shape[1] - k]
    return kth if kth.dtype == np.int64 else np.array([max(-(2**63), min(2**63 - 1, z)) for z in kth], np.int64)


def search_shard(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, far: np.ndarray, query_rows: np.ndarray, q: np.ndarray, to: np.ndarray, radius: np.ndarray, least: np.ndarray, k: int, step: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query places, ids and products of the k best for each query, among rows sorted by ``far``.

    ``to`` is each query's distance to the pivot, ``radius`` how far its candidates can be at most, ``least`` the
    product that they have at least.
    """
    low, high = np.searchsorted(far, to - radius, side="left"), np.searchsorted(far, to + radius, side="right")
    best, least, none = (np.zeros(0, np.int64),) * 3, least.copy(), np.iinfo(np.int64).min
    for at in range(int(low.min(initial=len(far))), int(high.max(initial=0)), step):
        end = min(at + step, len(far))
        open_ = np.flatnonzero((low < end) & (high > at))
        if not len(open_):
            continue
        told = products(q[open_], x[at:end])
        own = rows[None, at:end] == query_rows[open_, None]
        told[own] = none
        fresh = least[open_] == none
        if fresh.any() and end - at >= k:  # of a query's own k best here, none that is less can count
            least[open_[fresh]] = kth_of(told[fresh], k)
        i, j = np.nonzero((told >= least[open_, None]) & ~own)
        new = told[i, j]
        if new.dtype == object and any(abs(z) >= 2**63 for z in new):
            raise OverflowError("an inner product has no 64-bit integer")
        query, found, score = (np.concatenate(z) for z in zip(best, (open_[i], ids[at + j], new.astype(np.int64))))
        best = best_of(found, score, query, k)
        full, n = np.unique(best[0], return_counts=True)
        last = np.cumsum(n) - 1
        least[full[n >= k]] = np.maximum(least[full[n >= k]], best[2][last[n >= k]])
    return best


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, every: int = EVERY, pivots: int = 64, sample: int = 4_000, rows_per_shard: int = 25_000, block: int = 512, queries_per_task: int = 1 << 16, indexed: int = INDEXED) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query, ties to the smaller id.

    Queries are the rows whose id ``every`` divides, candidates all rows but the query's own: rows that share
    an id are queries and candidates of their own. Vectors take part as ``digitise`` says; each is searched
    among those of its own dimension. The ``indexed`` most frequent dimensions have an index each; vectors of any others
    meet in blocks of their dimension, unpruned. Fewer than k candidates give as many rows; a product that has no 64-bit integer raises; no query or an empty table gives none. Other columns are not read.
    """
    rows = checkpoint(digitise(vectors, id_col, vector_col))
    sizes = rows.groupBy("n").count().orderBy(F.desc("count"), "n").limit(indexed + 1).collect()
    often = sizes[:indexed]
    parts = [_of_dimension(rows.where(F.col("n") == width), width, n, k, every, pivots, sample, rows_per_shard, block, queries_per_task) for width, n in often]
    if len(sizes) > indexed:
        parts.append(_of_others(rows.where(~F.col("n").isin([width for width, _ in often])), k, every, rows_per_shard, block, queries_per_task))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, parts)


NAMES = ["shard", "part", "row", "vec_id", "v", "far", "radius", "least"]


def _answering(keys: list[str], k: int, block: int):
    """Of each shard, named by the keys, the stored rows, which come first (part -1), then its queries (part 0, a bounded number), in blocks."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, shard = None, None
        for group in sorted_groups(batches, [*keys, "part"]):
            mine = [group[c][0].as_py() for c in keys]
            width = len(group["v"][0].as_py()) // 8
            if group["part"][0].as_py() < 0:
                shard = mine
                here = group["row"].to_numpy(), group["vec_id"].to_numpy(), unpack(group["v"], width), group["far"].to_numpy()
                continue
            if mine != shard:
                continue
            for at in range(0, group.num_rows, block):
                some = group.slice(at, block)
                rows, ids = some["row"].to_numpy(), some["vec_id"].to_numpy()
                i, found, score = search_shard(*here, rows, unpack(some["v"], width), some["far"].to_numpy(), some["radius"].to_numpy(), some["least"].to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(rows[i]), pa.array(ids[i]), pa.array(found), pa.array(score)], ["query", "query_id", "vec_id", "score"])

    return answer


def _of_dimension(rows: DataFrame, width: int, n: int, k: int, every: int, pivots: int, sample: int, rows_per_shard: int, block: int, queries_per_task: int) -> DataFrame:
    """The search among ``n`` vectors that all have ``width`` components."""
    spark = rows.sparkSession

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unpack(batch["v"], width).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([float((x * x).sum(axis=1).max())])], ["top"])

    top = (rows.mapInArrow(squares, "top double").agg(F.max("top")).first()[0] or 0.0) + 1.0
    some = rows.where(draw("vec_id", "row") < draws_for(sample, n)).orderBy("vec_id", "v").toArrow()
    centre = fit_pivots(lift(unpack(some["v"], width), top), pivots) if some.num_rows else np.zeros((1, width + 1))
    index = spark.sparkContext.broadcast(centre)  # a fixed number of pivots

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = distances(lift(unpack(batch["v"], width), top), index.value)
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("row", "vec_id", "v")), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], ["row", "vec_id", "v", "cell", "far"])

    placed = checkpoint(rows.mapInArrow(keyed, "row long, vec_id long, v binary, cell int, far double"))
    ends = {c: (a, b) for c, a, b in placed.groupBy("cell").agg(F.min("far"), F.max("far")).collect()}  # as many as pivots
    edges = np.array([np.linspace(*ends.get(c, (0.0, 0.0)), BINS + 1) for c in range(len(centre))])
    low = F.element_at(F.array(*[F.lit(float(e[0])) for e in edges]), F.col("cell") + 1)
    wide = F.element_at(F.array(*[F.lit(float(max(e[-1] - e[0], 1e-300) / BINS)) for e in edges]), F.col("cell") + 1)
    placed = placed.withColumn("bin", F.least(F.lit(BINS - 1), F.floor((F.col("far") - low) / wide)).cast("int"))
    counts = {(c, b): m for c, b, m in placed.groupBy("cell", "bin").count().collect()}  # pivots times bins
    first, cuts, shards = layout(counts, len(centre), rows_per_shard)
    cell = np.array([s[0] for s in shards], np.int64)
    held = np.array([s[3] for s in shards], np.int64)
    step = edges[:, 1] - edges[:, 0]
    reach_low = np.array([edges[c, a] - step[c] for c, a, _, _ in shards])  # a bin more on either side: bins are floating point too
    reach_high = np.array([edges[c, b + 1] + step[c] for c, _, b, _ in shards])
    plan = spark.sparkContext.broadcast((first, cuts, cell, held, reach_low, reach_high))  # at most pivots * BINS shards and those by salt

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, b = batch["cell"].to_numpy(), batch["bin"].to_numpy()
            shard = plan.value[0][c, b] + batch["row"].to_numpy() % plan.value[1][c, b]
            none = pa.nulls(batch.num_rows, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.full(len(c), -1)), *(batch[x] for x in ("row", "vec_id", "v", "far")), none, none.cast(pa.int64())], NAMES)

    def asked(late: bool):
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, cuts, cell, held, below, above = plan.value
            for whole in batches:
                for start in range(0, whole.num_rows, 64):
                    batch = whole.slice(start, 64)
                    q = np.column_stack([unpack(batch["v"], width).astype(float), np.zeros(batch.num_rows)])
                    to = distances(q, index.value)[:, cell]
                    bound = shard_bounds(to, below, above)
                    order = np.argsort(bound, axis=1, kind="stable")
                    before = np.cumsum(held[order], axis=1) - held[order]
                    near = np.zeros(bound.shape, bool)
                    np.put_along_axis(near, order, before <= k, axis=1)  # until more than k rows are in sight
                    radius = batch["radius"].to_numpy(zero_copy_only=False)
                    i, shard = np.nonzero(~near & (bound <= radius[:, None]) if late else near)
                    take = pa.array(i)
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.zeros(len(i), np.int64)), *(batch[x].take(take) for x in ("row", "vec_id", "v")), pa.array(to[i, shard]), pa.array(radius[i]), batch["least"].take(take)], NAMES)

        return send

    names = "shard long, part long, row long, vec_id long, v binary, far double, radius double, least long"
    questions = rows.where(F.col("vec_id") % every == 0)

    def round_of(asking: DataFrame) -> DataFrame:
        busy = dict(asking.groupBy("shard").count().where(F.col("count") > queries_per_task).collect())  # of the shards
        copies = F.lit(1) if not busy else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for c, m in busy.items() for x in (c, -(-m // queries_per_task))]), F.col("shard")), F.lit(1))
        kept = placed.mapInArrow(stored, names).select(F.explode(F.sequence(F.lit(0), copies.cast("int") - 1)).alias("copy"), *NAMES)
        both = kept.unionByName(asking.withColumn("copy", F.pmod(F.xxhash64("row"), copies).cast("int")))
        dealt = both.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "part", "far")
        return dealt.mapInArrow(_answering(["shard", "copy"], k, block), "query long, query_id long, vec_id long, score long")

    near = checkpoint(round_of(questions.withColumns({"radius": F.lit(float("inf")), "least": F.lit(-(2**63))}).mapInArrow(asked(False), names)))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("kth"))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = unpack(batch["v"], width).astype(float)
            most = (q * q).sum(axis=1) + top  # distance^2 = most - 2 * product
            least = batch["kth"].to_numpy(zero_copy_only=False).astype(float)
            radius = np.sqrt(np.maximum(0.0, most - 2.0 * least + SLACK * np.maximum(most, 1.0))) + 1e-9
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("row", "vec_id", "v")), pa.array(np.where(np.isnan(least), np.inf, radius)), batch["kth"].fill_null(-(2**63))], ["row", "vec_id", "v", "radius", "least"])

    bounded = questions.join(kth, "row", "left").select("row", "vec_id", "v", "kth").mapInArrow(reach, "row long, vec_id long, v binary, radius double, least long")
    found = near.unionByName(round_of(bounded.mapInArrow(asked(True), names)))
    told = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return told.select("query_id", "rank", "vec_id", "score")


def _of_others(rows: DataFrame, k: int, every: int, rows_per_shard: int, block: int, queries_per_task: int) -> DataFrame:
    """The search among vectors of any number of dimensions: every query of a dimension against all its rows, shard by shard.

    A dimension has a shard for each ``rows_per_shard`` of its rows, and each shard a copy for each ``queries_per_task`` of its queries.
    """
    asks = F.col("vec_id") % every == 0
    sizes = checkpoint(rows.groupBy("n").agg(F.ceil(F.count("*") / rows_per_shard).alias("shards"), F.greatest(F.lit(1), F.ceil(F.count(F.when(asks, 1)) / queries_per_task)).alias("copies")))
    told = rows.join(sizes.hint("shuffle_hash"), "n")
    blank = [F.lit(0.0).alias("far"), F.lit(float("inf")).alias("radius"), F.lit(-(2**63)).cast("long").alias("least")]
    some = F.xxhash64("row")
    kept = told.select("n", F.pmod(some, "shards").alias("shard"), F.explode(F.expr("sequence(0L, copies - 1)")).alias("copy"), F.lit(-1).alias("part"), "row", "vec_id", "v", *blank)
    asked = told.where(asks).select("n", F.explode(F.expr("sequence(0L, shards - 1)")).alias("shard"), F.pmod(F.xxhash64(some), "copies").alias("copy"), F.lit(0).alias("part"), "row", "vec_id", "v", *blank)
    dealt = kept.unionByName(asked).repartition("n", "shard", "copy").sortWithinPartitions("n", "shard", "copy", "part")
    found = dealt.mapInArrow(_answering(["n", "shard", "copy"], k, block), "query long, query_id long, vec_id long, score long")
    told = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return told.select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = r"""
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY rid ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""
