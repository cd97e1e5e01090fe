"""Approximate nearest neighbours by learned partitions, for largest inner products.

A bounded sample of vectors gives a neighbour graph, which is cut into parts of
equal size with few edges between them: by recursive bisection along the
graph's slowest vibration, then swaps of vertices that save edges. A small
classifier learns from a vector the share of its neighbours in each part.
Every vector is indexed in its most probable part; a query is sent to its most
probable parts and compared with all vectors there in double precision.

Parts are put together to blocks of BLOCK vectors at most, and a larger part is
split into such blocks by hash of the id. The queries of a block are split into
groups, so that a task sees BLOCK vectors and QUERY_GROUP queries at most, about,
however many copies one vector has. A task compares a query with the parts that
it probes, and hands on its nearest in the whole block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from funnelspark.llm.common import bounded_rows, materialize

#: The sample that the graph and the classifier are made from.
SAMPLE = 4096
#: Vectors for each part aimed at; a part needs enough of the sample, so there are MAX_PARTS at most.
ROWS_PER_PART = 1000
MAX_PARTS = 64
GRAPH_NEIGHBOURS = 16
#: Share of a sampled vector's neighbours that the probed parts have to hold.
TARGET = 0.93
BLOCK = 4096
QUERY_GROUP = 1024
NEAREST = 20


def usable(vector: Column) -> Column:
    """Not null, not zero, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbours(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k rows with the largest inner product with each row, itself left out."""
    out = np.empty((len(vectors), k), dtype=np.int64)
    for start in range(0, len(vectors), 512):
        near = vectors[start : start + 512] @ vectors.T
        near[np.arange(len(near)), np.arange(start, start + len(near))] = -np.inf
        out[start : start + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def _bisect(weights: np.ndarray, passes: int = 6) -> np.ndarray:
    """Two halves (False, True) of a graph with few edges between them."""
    n = len(weights)
    degree = np.maximum(weights.sum(axis=1), 1e-9)
    x = np.random.default_rng(n).normal(size=n)
    steady = np.sqrt(degree)
    steady /= np.linalg.norm(steady)
    scaled = weights / np.sqrt(degree)[:, None] / np.sqrt(degree)[None, :]
    for _ in range(60):
        x = scaled @ x + x
        x -= steady * (steady @ x)
        x /= max(np.linalg.norm(x), 1e-12)
    side = np.zeros(n, dtype=bool)
    side[np.argsort(x, kind="stable")[n // 2 :]] = True
    for _ in range(passes):
        across = weights @ np.where(side, 1.0, 0.0)
        gain = np.where(side, degree - 2 * across, 2 * across - degree)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left])], right[np.argsort(-gain[right])]
        m = min(len(left), len(right), max(1, n // 20))
        saves = gain[left[:m]] + gain[right[:m]] - 2 * weights[left[:m], right[:m]] > 1e-9
        if not saves.any():
            break
        side[left[:m][saves]], side[right[:m][saves]] = True, False
    return side


def partition(graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each vertex of a neighbour graph (rows of neighbours), parts of nearly equal size."""
    n, k = graph.shape
    label = np.zeros(n, dtype=np.int64)
    work, done = [(np.arange(n), parts)], 0
    while work:
        members, share = work.pop()
        if share == 1 or len(members) < 2:
            label[members] = done
            done += 1
            continue
        place = np.full(n, -1)
        place[members] = np.arange(len(members))
        to = place[graph[members]]
        weights = np.zeros((len(members), len(members)), dtype=np.float32)
        rows = np.repeat(np.arange(len(members)), k)
        inside = to.ravel() >= 0
        np.add.at(weights, (rows[inside], to.ravel()[inside]), 1)
        side = _bisect(weights + weights.T)
        work += [(members[~side], share // 2), (members[side], share - share // 2)]
    return label


def _features(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.concatenate([vectors / np.maximum(norm, 1e-12), np.ones((len(vectors), 1))], axis=1)


def fit_classifier(vectors: np.ndarray, target: np.ndarray, hidden: int = 128, steps: int = 400, rate: float = 0.01) -> list[np.ndarray]:
    """Weights of a network with one hidden layer that predicts the rows of ``target`` (shares of parts)."""
    rng = np.random.default_rng(4)
    x = _features(vectors)
    weights = [rng.normal(size=(x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]) * 2, rng.normal(size=(hidden + 1, target.shape[1])) * 0.05]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        h = np.concatenate([np.maximum(x @ weights[0], 0), np.ones((len(x), 1))], axis=1)
        z = h @ weights[1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        back = (p - target) / len(x)
        grads = [x.T @ ((back @ weights[1][:-1].T) * (h[:, :-1] > 0)), h.T @ back]
        for w, g, m, v in zip(weights, grads, first, second):
            g += 1e-5 * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights


def probable(weights: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Log odds of each part."""
    x = _features(vectors)
    return np.concatenate([np.maximum(x @ weights[0], 0), np.ones((len(x), 1))], axis=1) @ weights[1]


def learn(sample: np.ndarray, parts: int) -> tuple[list[np.ndarray], int]:
    """The classifier, and the number of parts that a query has to probe."""
    k = min(GRAPH_NEIGHBOURS, len(sample) - 1)
    if parts < 2 or k < 1:
        return [], 1
    graph = neighbours(sample, k)
    label = partition(graph, parts)
    share = np.zeros((len(sample), parts))
    np.add.at(share, (np.repeat(np.arange(len(sample)), k), label[graph].ravel()), 1 / k)
    # half of the weight on the vector's own part, which is where it will be indexed
    share = 0.5 * share
    share[np.arange(len(sample)), label] += 0.5
    # judged on a classifier that hasn't seen the judged rows; the one used has seen all
    judged = np.arange(len(sample)) % 5 == 0
    order = np.argsort(-probable(fit_classifier(sample[~judged], share[~judged]), sample), axis=1)
    held = order[:, 0]
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(sample), 0), axis=1)
    reached = rank[np.repeat(np.flatnonzero(judged), k), held[graph[judged]].ravel()]
    recall = np.cumsum(np.bincount(reached, minlength=parts)) / len(reached)
    return fit_classifier(sample, share), int(np.searchsorted(recall, TARGET) + 1)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dimension)


def _route(rows: DataFrame, weights: list[np.ndarray], dimension: int, probes: int) -> DataFrame:
    """``rows`` (id, vector) with their ``probes`` most probable parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.zeros((batch.num_rows, 1), dtype=np.int32)
            if weights:
                odds = probable(weights, _matrix(batch.column("vector"), dimension))
                part = np.argsort(-odds, axis=1, kind="stable")[:, :probes].astype(np.int32)
            ends = pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32))
            parts = pa.ListArray.from_arrays(ends, pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), parts], names=["id", "vector", "parts"])

    return rows.select("id", "vector").mapInArrow(run, "id long, vector array<double>, parts array<int>")


def blocks_of(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """First and last block of each part: small parts share one, parts of more than BLOCK rows have several of their own."""
    out, block, room = {}, -1, 0
    for part, n in sorted(sizes.items()):
        if n > room:
            block, room = block + 1, BLOCK
        more = max(0, -(-n // BLOCK) - 1)
        out[part] = block, block + more
        block, room = block + more, 0 if more else room - n
    return out


def nearest_of(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, ...]:
    """(query id, id, score) of the k best of ``vectors`` for each query, ties to smaller ids, own id left out.

    Products are added up in the order of the components, so equal vectors have equal scores.
    """
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    out = []
    for start in range(0, len(queries), 256):
        q, qid = queries[start : start + 256], query_ids[start : start + 256]
        score = np.zeros((len(q), len(vectors)))
        for d in range(vectors.shape[1]):
            score += q[:, d, None] * vectors[None, :, d]
        score[qid[:, None] == ids[None, :]] = -np.inf
        if len(ids) > k:
            least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k, None]
            over, equal = score > least, score == least
            keep = over | (equal & (np.cumsum(equal, axis=1) <= k - over.sum(axis=1, keepdims=True)))
        else:
            keep = np.ones(score.shape, dtype=bool)
        keep &= score > -np.inf
        row, column = np.nonzero(keep)
        out.append((qid[row], ids[column], score[row, column]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def best_of(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, ...]:
    """The k best of each query among (query id, id, score) found in several parts; a repeated id counts once, with its best score."""
    order = np.lexsort((-scores, ids, query_ids))
    query_ids, ids, scores = query_ids[order], ids[order], scores[order]
    once = np.ones(len(ids), dtype=bool)
    once[1:] = (ids[1:] != ids[:-1]) | (query_ids[1:] != query_ids[:-1])
    query_ids, ids, scores = query_ids[once], ids[once], scores[once]
    order = np.lexsort((ids, -scores, query_ids))
    query_ids, ids, scores = query_ids[order], ids[order], scores[order]
    place = np.arange(len(ids)) - np.searchsorted(query_ids, query_ids, side="left")
    return query_ids[place < k], ids[place < k], scores[place < k]


def search(vectors: DataFrame, is_query: Column, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for the rows of ``vectors`` (vec_id, embedding) where ``is_query``.

    Vectors that are null, zero, not finite, or of another length than most take
    no part; rows without vec_id neither. A repeated vec_id counts once in a
    query's list. No usable rows give no result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], result)
    dimension, n = lengths[0]["d"], lengths[0]["n"]
    rows = rows.filter(F.size("vector") == dimension)
    drawn = bounded_rows(rows.select("id", "vector"), F.xxhash64("id"), SAMPLE).orderBy("id").toArrow()
    sample = _matrix(drawn["vector"].combine_chunks(), dimension)
    parts = max(1, min(MAX_PARTS, n // ROWS_PER_PART))
    weights, probes = learn(sample, parts)

    index = materialize(_route(rows, weights, dimension, 1).withColumn("part", F.col("parts")[0]).drop("parts"), "index")
    asked = materialize(_route(rows.filter("asks"), weights, dimension, probes), "queries")
    blocks = blocks_of({r["part"]: r["n"] for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()})  # MAX_PARTS rows at most
    first, last = (F.create_map(*(F.lit(x) for part, ends in blocks.items() for x in (part, ends[i]))) for i in (0, 1))
    reached = F.flatten(F.transform(F.filter("parts", lambda p: first[p].isNotNull()), lambda p: F.sequence(first[p], last[p])))
    probing = asked.withColumn("block", F.explode(F.array_distinct(reached)))
    plan = materialize(probing.groupBy("block").agg(F.ceil(F.count("*") / QUERY_GROUP).cast("int").alias("groups")), "blocks")  # a row for each block
    hashed = lambda n: F.pmod(F.xxhash64("id", F.lit(9)), n).cast("int")
    held_in = first[F.col("part")] + hashed(last[F.col("part")] - first[F.col("part")] + 1)
    left = probing.join(plan, "block").withColumn("group", hashed(F.col("groups"))).select("block", "group", "id", "vector", "parts")
    right = index.withColumn("block", held_in).join(plan, "block")
    right = right.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("block", "group", "id", "vector", "part")

    def compare(queries: pa.Table, held: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and held.num_rows:
            asking, vectors = (_matrix(t["vector"].combine_chunks(), dimension) for t in (queries, held))
            probed = np.asarray(queries["parts"].combine_chunks().flatten()).reshape(queries.num_rows, -1)
            ids, query_ids, part = held["id"].to_numpy(), queries["id"].to_numpy(), held["part"].to_numpy()
            for p in np.unique(part):
                here, probing_it = part == p, (probed == p).any(axis=1)
                found.append(nearest_of(asking[probing_it], query_ids[probing_it], vectors[here], ids[here], k))
        found = best_of(*(np.concatenate(c) for c in zip(*found)), k)
        kinds = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds, found)})

    key = ["block", "group"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
