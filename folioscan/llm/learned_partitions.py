"""Approximate nearest neighbours by learned partitions.

A graph of nearest neighbours over a bounded sample of vectors is cut into equal
parts by recursive bisection: each cut begins at the median of the graph's
slowest eigenvector and is refined by swaps that shorten it.  A small network
learns which parts a vector's neighbours lie in.  It puts every vector of the
table into its most probable part, and sends each query to as many of its most
probable parts as the sample needs for ``COVERAGE`` of its neighbours.  What is
found there is ranked again by exact inner products.

Equal vectors are one candidate, with their ``k + 1`` smallest ids; equal
queries are searched once.  Parts are compared with queries block by block, so
that no task sees a part whole.  The number of parts follows the number of
vectors.  The sample has ``PER_PART`` vectors a part, ``LEAST_SAMPLE`` at least;
with at most ``MOST_PARTS`` parts it is bounded.

Defined results: vectors that are null, empty, all zero or hold a null or a
number that is not finite take no part, neither do vectors of another length
than the most common one (the smallest of equally common ones) or without id;
ties go to the smaller id; rows that repeat an id are one vector for each text
of its components; fewer candidates than k give all; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from folioscan.llm.common import stored

NEIGHBOURS, HIDDEN, COVERAGE = 16, 64, 0.98
PER_PART, LEAST_SAMPLE, MOST_PARTS, PART_SIZE = 24, 4096, 2048, 1024
CANDIDATE_BLOCK, QUERY_BLOCK = 1024, 256
HELD = 1 << 20  # candidates that a task holds before it ranks them


@dataclass
class Router:
    """A small network from a vector to parts, and how many of them to search."""

    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray
    probes: int

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        return np.maximum(0, vectors @ self.first + self.first_bias) @ self.second + self.second_bias


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each vector, by inner product."""
    k = min(k, len(vectors) - 1)
    out = np.empty((len(vectors), k), np.int64)
    for a in range(0, len(vectors), 512):
        near = vectors[a:a + 512] @ vectors.T
        near[np.arange(len(near)), a + np.arange(len(near))] = -np.inf
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
        out[a:a + 512] = np.take_along_axis(top, order, 1)
    return out


def bisect(graph: np.ndarray, members: np.ndarray, rng: np.random.Generator, rounds: int = 40, swaps: int = 20) -> np.ndarray:
    """Which half each of ``members`` belongs to, the halves being equal."""
    n = len(members)
    place = np.full(len(graph), -1)
    place[members] = np.arange(n)
    near = place[graph[members]]
    source = np.repeat(np.arange(n), near.shape[1])[near.ravel() >= 0]
    target = near.ravel()[near.ravel() >= 0]
    a, b = np.r_[source, target], np.r_[target, source]
    degree = np.bincount(a, minlength=n) + 1e-9
    x = rng.standard_normal(n)
    for _ in range(rounds):  # towards the slowest mode of a random walk
        x = 0.5 * x + 0.5 * np.bincount(a, x[b], n) / degree
        x -= (x * degree).sum() / degree.sum()
        x /= np.abs(x).max() + 1e-30
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[n // 2:]] = True
    for _ in range(swaps):
        other = np.bincount(a, side[b] != side[a], n)
        gain = 2 * other - np.bincount(a, minlength=n)  # shortening if a member moves
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        better = int((gain[left[:m]] + gain[right[:m]] > 0).sum())
        if not better:
            break
        move = np.r_[left[:max(1, better // 2)], right[:max(1, better // 2)]]
        side[move] = ~side[move]
    return side


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """A part for each node; ``parts`` is a power of two."""
    rng = np.random.default_rng(seed)
    label = np.zeros(len(graph), np.int64)
    step = 1
    while step < parts:
        for p in range(step):
            members = np.flatnonzero(label == p)
            if len(members) > 1:
                label[members[bisect(graph, members, rng)]] += step
        step *= 2
    return label


def fit(vectors: np.ndarray, parts: int, k: int, epochs: int = 30, seed: int = 6) -> Router:
    """Cuts the sample's graph and learns to route."""
    rng = np.random.default_rng(seed)
    graph = neighbour_graph(vectors, NEIGHBOURS)
    label = balanced_parts(graph, parts)
    goal = np.zeros((len(vectors), parts), np.float32)
    np.add.at(goal, (np.repeat(np.arange(len(vectors)), graph.shape[1]), label[graph].ravel()), 1)
    goal[np.arange(len(vectors)), label] += graph.shape[1] / 4 + 1  # its own part counts most of any one
    goal /= goal.sum(1, keepdims=True)
    spread = vectors.std() + 1e-12
    x = (vectors / spread).astype(np.float32)
    p = [rng.standard_normal((x.shape[1], HIDDEN)).astype(np.float32) * x.shape[1] ** -0.5, np.zeros(HIDDEN, np.float32),
         rng.standard_normal((HIDDEN, parts)).astype(np.float32) * HIDDEN ** -0.5, np.zeros(parts, np.float32)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(order), 256):
            rows = order[a:a + 256]
            hidden = np.maximum(0, x[rows] @ p[0] + p[1])
            out = hidden @ p[2] + p[3]
            out = np.exp(out - out.max(1, keepdims=True))
            wrong = (out / out.sum(1, keepdims=True) - goal[rows]) / len(rows)
            back = (wrong @ p[2].T) * (hidden > 0)
            step += 1
            for q, g, i in zip(p, (x[rows].T @ back, back.sum(0), hidden.T @ wrong, wrong.sum(0)), range(4)):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                q -= 5e-3 * (0.2 if 3 * epoch > 2 * epochs else 1) * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    router = Router((p[0] / spread).astype(np.float64), *(q.astype(np.float64) for q in p[1:]), parts)
    # As many parts as hold nearly all neighbours that sampled vectors have in the sample.
    tried = np.arange(0, len(vectors), max(1, len(vectors) // 1024))
    scores = router.scores(vectors)
    rank = np.empty_like(scores[tried], dtype=np.int64)
    np.put_along_axis(rank, np.argsort(-scores[tried], axis=1, kind="stable"), np.arange(parts)[None], 1)
    near = neighbour_graph(vectors, k)[tried]
    found = np.take_along_axis(rank, scores.argmax(1)[near], 1)
    covered = (np.bincount(found.ravel(), minlength=parts).cumsum()) / found.size
    router.probes = int(np.searchsorted(covered, COVERAGE) + 1)
    return router


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id and vec (of doubles) of the rows that take part."""
    vec = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id IS NOT NULL AND vec IS NOT NULL")
    finite = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(finite & F.exists("vec", lambda x: x != 0))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (size["n"] if size else 0)).distinct()


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """vec, its smallest id as ``code``, and its k + 1 smallest ids."""
    smallest = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("code"), "vec", "ids")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _route(shared, most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each vector with its most probable parts."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = shared.value.scores(_matrix(batch.column("vec")))
            parts = np.argsort(-scores, axis=1, kind="stable")[:, :most or shared.value.probes]
            rows = np.repeat(np.arange(len(parts)), parts.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts.ravel().astype(np.int32)), batch.column("code").take(pa.array(rows)), batch.column("vec").take(pa.array(rows))],
                ["part", "code", "vec"])

    return run


def _best(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (query, code, score) the k + 1 best of each query."""
    order = np.lexsort((rows[1], -rows[2], rows[0]))
    query = rows[0][order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    return [x[order[place <= k]] for x in rows]


def _ranker(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k + 1 best distinct candidates of each query in the pairs of blocks
    that a task sees, by inner products summed in extended precision."""
    def emit(rows: list[np.ndarray]):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["query", "code", "score"])

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            for q, qv, c, cv in zip(*(batch.column(n) for n in ("query", "query_vec", "code", "code_vec"))):
                queries, codes = q.values.to_numpy(), c.values.to_numpy()
                left, right = (np.stack([x.to_numpy() for x in _lists(v)]) for v in (qv, cv))
                near = left @ right.T
                least = np.partition(near, -k - 1, axis=1)[:, -k - 1] if len(codes) > k + 1 else np.full(len(queries), -np.inf)
                # Ties that rounding may have parted are kept until they are summed exactly.
                row, column = np.nonzero(near >= (least - 1e-9 * (np.abs(left).sum(1) * np.abs(right).max()))[:, None])
                exact = (left.astype(np.longdouble)[row] * right[column]).sum(1).astype(np.float64)
                held = [np.concatenate(x) for x in zip(held, (queries[row], codes[column], exact))]
                if len(held[0]) > HELD:
                    held = _best(held, k)
                    if len(held[0]) > HELD // 2:
                        yield from emit(held)
                        held = [x[:0] for x in held]
        if len(held[0]):
            yield from emit(_best(held, k))

    return run


def _lists(scalar: pa.ListScalar) -> list[pa.Array]:
    lists = scalar.values
    ends = lists.offsets.to_numpy()
    return [lists.values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _in_blocks(rows: DataFrame, size: int, names: tuple[str, str]) -> DataFrame:
    """Vectors of a part in blocks of about ``size``."""
    counts = rows.groupBy("part").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))  # a row a part
    return (rows.join(F.broadcast(counts), "part").groupBy("part", F.pmod(F.xxhash64("code"), "blocks").alias("block"))
            .agg(F.collect_list(F.struct("code", "vec")).alias("rows"))
            .select("part", F.col("rows.code").alias(names[0]), F.col("rows.vec").alias(names[1])))


def parts_for(vectors: int) -> int:
    return int(min(MOST_PARTS, max(2, 2 ** round(math.log2(max(2, vectors) / PART_SIZE)))))


def nearest(table: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which
    ``is_query`` holds."""
    spark = table.sparkSession
    rows = stored(valid_vectors(table), "vectors")
    known = stored(distinct_vectors(rows, k), "distinct-vectors")
    count = known.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not count:
        return empty
    parts = parts_for(count)
    sample = known.orderBy(F.xxhash64("code"), "code").limit(max(LEAST_SAMPLE, PER_PART * parts)).select("vec").toArrow()
    vectors = _matrix(sample.column("vec").combine_chunks())
    if len(vectors) < 4 * parts:  # too few to cut: one part
        dim = vectors.shape[1]
        router = Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    else:
        router = fit(vectors, parts, k)
    shared = spark.sparkContext.broadcast(router)
    routed = "part int, code long, vec array<double>"
    candidates = stored(known.select("code", "vec").mapInArrow(_route(shared, 1), routed), "routed")
    asked = stored(rows.where(is_query).join(known.select("vec", "code"), "vec").select("vec_id", "code"), "asked")
    asking = known.select("code", "vec").join(asked.select("code").distinct(), "code", "left_semi")
    sent = stored(asking.mapInArrow(_route(shared, None), routed), "sent")
    pairs = _in_blocks(sent, QUERY_BLOCK, ("query", "query_vec")).join(_in_blocks(candidates, CANDIDATE_BLOCK, ("code", "code_vec")), "part")
    found = pairs.select("query", "query_vec", "code", "code_vec").mapInArrow(_ranker(k), "query long, code long, score double")
    by_code = Window.partitionBy("query").orderBy(F.desc("score"), "code")
    found = stored(found.withColumn("place", F.row_number().over(by_code)).where(F.col("place") <= k + 1).drop("place"), "found")
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    each = found.join(known.select("code", "ids"), "code").select("query", "score", F.explode("ids").alias("vec_id"))
    each = each.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    # k + 1 for each distinct query vector: without the query itself k remain.
    lists = each.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("list"))
    answers = asked.join(lists.withColumnRenamed("query", "code"), "code").select(
        F.col("vec_id").alias("query_id"), F.col("list"))
    answers = answers.select("query_id", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("list"))
    return answers.select("query_id", F.posexplode("list").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
