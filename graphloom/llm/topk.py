"""Exact top-k inner products with KD-trees per shard.

Each component x of a vector becomes floor(SCALE * x), x as a double; scores are integer inner
products. Vectors are dealt to shards by hash of vec_id. A shard's KD-tree splits at the median
of its widest dimension down to LEAF vectors and keeps tight bounding boxes; the score of a
query q in a box is at most the sum of max(q_d * low_d, q_d * high_d). Per query the tree is
walked best first: the open node with the highest bound next, until that bound is below the
query's k-th score so far; equal bounds are still opened, as ties go to the smaller vec_id.

Two rounds propagate the k-th score between shards. In the first, each query meets one shard, its
home by hash of its id; the k-th score found there, exact for that shard, goes with the query to
all other shards, whose trees prune with it from the first node and return only what reaches it.
Both rounds' results merge by one ranking per query.

Exact: a box is passed over only if nothing in it can enter the result. Queries and vectors
travel packed, about PACK vectors a row. A task holds one shard's tree and meets at most
TASK_QUERIES queries: more are dealt to several tasks, each with the shard's vectors. Each query
meets each shard: the work of a stated query set against all rows. Shards
grow with the input up to MAX_SHARD vectors, which bounds how often queries are sent.

Defined results: vectors that are null or hold a null or non-finite component take no part;
vectors of different lengths don't meet; candidates with the query's own vec_id are its own
row; of several rows that are one query id the least vector asks; repeated candidates are
ranked each; fewer than k candidates: all of them; scores beyond a long stop at its limits;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from graphloom.llm.common import cut, read, ship
from graphloom.llm.vectors import finite, rows_of

SCALE = 64
K = 20
EVERY = 20
LEAF = 256
PACK = 512
MIN_SHARD, MAX_SHARD = 4096, 262_144
TASK_QUERIES = 16_384
EXACT = 1 << 53
LONG = (1 << 63) - 1
LOWEST = -(1 << 63)


def quantised(row: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Whole numbers as doubles: exact, as floor of a double is one."""
    return np.floor(row.astype(np.float64) * scale)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as long; beyond a long's range its limits."""
    if a.shape[1] == 0 or not a.size or not b.size or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object)
    exact = whole(a).dot(whole(b).T)
    return np.array([[max(LOWEST, min(LONG, v)) for v in r] for r in exact], np.int64).reshape(exact.shape)


class KdTree:
    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.below: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        self.span: list[tuple[int, int]] = []
        todo = [np.arange(len(ids))] if len(ids) else []
        made = len(todo)
        for own in todo:  # grows while it is walked: level by level
            box = x[own]
            low, high = box.min(axis=0), box.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            if len(own) <= leaf or x.shape[1] == 0 or not (high > low).any():
                self.below.append(None)
                self.rows.append(own)
                continue
            half = len(own) // 2
            order = np.argpartition(box[:, int(np.argmax(high - low))], half)
            self.below.append((made, made + 1))
            self.rows.append(None)
            made += 2
            todo += [own[order[:half]], own[order[half:]]]
        # leaves become slices, read without copies
        leaves = [r for r in self.rows if r is not None]
        order = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
        self.ids, self.x = ids[order], np.ascontiguousarray(x[order])
        at = 0
        for r in self.rows:
            n = 0 if r is None else len(r)
            self.span.append((at, at + n))
            at += n
        self.rows = []
        self.largest = float(np.abs(x).max()) if x.size else 0.0
        self.low_m = np.array(self.low).reshape(len(self.low), x.shape[1])
        self.high_m = np.array(self.high).reshape(len(self.high), x.shape[1])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Highest possible score of each query in each node; as doubles, raised past rounding."""
        up = np.maximum(queries, 0) @ self.high_m.T + np.minimum(queries, 0) @ self.low_m.T
        size = np.abs(queries) @ np.maximum(np.abs(self.high_m), np.abs(self.low_m)).T
        return np.where(size < EXACT, up, up + size * 1e-12)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query number, vec_ids, scores): the best k here among those that reach kth."""
        if not len(self.ids):
            return
        bounds = self.bounds(queries)
        for i in range(len(query_ids)):
            least, bound, q = int(kth[i]), bounds[i], queries[i]
            small = not q.size or self.largest * float(np.abs(q).max()) * len(q) < EXACT
            ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
            heap = [(-bound[0], 0)]
            while heap:
                up, node = heapq.heappop(heap)
                if -up < least:
                    break
                if self.below[node] is not None:
                    for child in self.below[node]:
                        if bound[child] >= least:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                start, end = self.span[node]
                s = self.x[start:end] @ q if small else products(self.x[start:end], q[None, :])[:, 0]
                good = np.nonzero(s >= least)[0]
                if len(good):
                    found = self.ids[start:end][good]
                    other = found != query_ids[i]
                    ids, scores = np.concatenate([ids, found[other]]), np.concatenate([scores, s[good][other].astype(np.int64)])
                    if len(ids) >= k:
                        top = np.lexsort((ids, -scores))[:k]
                        ids, scores = ids[top], scores[top]
                        least = max(least, int(scores[-1]))
            if len(ids):
                yield i, ids, scores


def _pack(scale: int, kind: int):
    """Vectors (vec_id, embedding, shard, kth) packed by length and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list[int], list[np.ndarray], list[int]]] = {}

        def row(key: tuple[int, int]) -> pa.RecordBatch:
            ids, x, kth = held.pop(key)
            packed = [np.array(ids, np.int64), np.stack(x), np.array(kth, np.int64)]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[1]], pa.int32()), pa.array([kind], pa.int32()), pa.array([key[0]], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in packed]],
                ["shard", "kind", "dim", "ids", "vectors", "kth"],
            )

        for b in batches:
            shard, kth = b.column("shard").to_pylist(), b.column("kth").to_pylist()
            for i, x in enumerate(rows_of(b.column("embedding"))):
                if not finite(x) or not b.column("vec_id")[i].is_valid:
                    continue
                key = (len(x), shard[i])
                own = held.setdefault(key, ([], [], []))
                own[0].append(b.column("vec_id")[i].as_py())
                own[1].append(quantised(x, scale))
                own[2].append(kth[i])
                if len(own[0]) >= PACK:
                    yield row(key)
        for key in list(held):
            yield row(key)

    return run


PACKED_ROW = "shard int, kind int, dim int, ids binary, vectors binary, kth binary"


def _search(k: int, leaf: int):
    """Rows sorted by task, length and kind: a shard's vectors, then the blocks of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, xs, tree = None, [], [], None
        for b in batches:
            for r in range(b.num_rows):
                key = (b.column("task")[r].as_py(), b.column("dim")[r].as_py())
                if key != current:
                    current, ids, xs, tree = key, [], [], None
                own = np.frombuffer(b.column("ids")[r].as_py(), np.int64)
                x = np.frombuffer(b.column("vectors")[r].as_py(), np.float64).reshape(len(own), key[1])
                if b.column("kind")[r].as_py() == 0:
                    ids.append(own)
                    xs.append(x)
                    continue
                if not ids:
                    continue
                if tree is None:
                    tree = KdTree(np.concatenate(ids), np.concatenate(xs), leaf)
                kth = np.frombuffer(b.column("kth")[r].as_py(), np.int64)
                found = list(tree.search(own, x, kth, k))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([np.full(len(v), own[i]) for i, v, _ in found])), pa.array(np.concatenate([v for _, v, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))],
                        ["query_id", "vec_id", "score"],
                    )

    return run


def _meet(vectors: DataFrame, queries: DataFrame, shards: int, parts: int, k: int, leaf: int) -> DataFrame:
    """Rows (query_id, vec_id, score): packed queries, each for one (shard, part), against the packed vectors of the shard, which go to all its parts."""
    spread = vectors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = spread.unionByName(queries).withColumn("task", F.col("shard") * parts + F.col("part"))
    met = met.repartitionById(shards * parts, "task").sortWithinPartitions("task", "dim", "kind").select("task", "kind", "dim", "ids", "vectors", "kth")
    return met.mapInArrow(_search(k, leaf), "query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, leaf: int = LEAF, min_shard: int = MIN_SHARD, max_shard: int = MAX_SHARD, task_queries: int = TASK_QUERIES) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): vectors (vec_id, embedding) that is_query names, against all."""
    ship(vectors.sparkSession)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    n = own.count()
    shards = max(1, -(-n // min(max_shard, max(min_shard, n // 64))))
    none = F.lit(LOWEST + 1) - 1
    home = lambda key: F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
    packed = cut(own.select("vec_id", "embedding", home("vec_id").alias("shard"), none.alias("kth")).repartitionById(shards, "shard").mapInArrow(_pack(scale, 0), PACKED_ROW), "topk-vectors")
    asked = cut(own.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "topk-queries")
    m = asked.count()
    # first round: as many parts as keep a task at task_queries; a query's part goes by another hash than its shard
    pack_at = lambda rows, parts: rows.withColumn("shard", F.col("shard") * parts + F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(parts)).cast("int")).mapInArrow(_pack(scale, 1), PACKED_ROW).withColumn("part", F.col("shard") % parts).withColumn("shard", F.expr(f"shard div {parts}").cast("int"))
    parts = max(1, -(-m // (shards * task_queries)))
    first = cut(_meet(packed, pack_at(asked.select("vec_id", "embedding", home("vec_id").alias("shard"), none.alias("kth")), parts), shards, parts, k, leaf), "topk-found")
    if shards == 1:
        found = first
    else:
        reached = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        kth = F.when(F.col("n") >= k, F.col("least")).otherwise(none).alias("kth")
        known = asked.join(reached, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "embedding", kth)
        parts = max(1, -(-m // task_queries))
        # packed by home, so that a block goes to all shards but one
        blocks = cut(pack_at(known.withColumn("shard", home("vec_id")).select("vec_id", "embedding", "shard", "kth"), parts), "topk-blocks")
        sent = blocks.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("to <> shard").drop("shard").withColumnRenamed("to", "shard")
        found = first.unionAll(_meet(packed, sent, shards, parts, k, leaf))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP9_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda c: floor({SCALE} * c)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % {EVERY} = 0 AND q.vec_id <> v.vec_id AND len(q.x) = len(v.x)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}
"""
