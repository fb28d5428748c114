"""Embedding near-dedup with a pivot-permutation index.

A vector is described by its NEAREST closest pivots, an ordered prefix of its pivot permutation.
Inverted lists hold, for each label and pair of pivots, the vectors that have both in their
prefix: whatever meets in a list shares at least two pivots, so the shared-pivot count needs no
list of a single pivot to be paired out. What meets is verified: it links if its cosine in double
precision is CUTOFF or more. A link counts in the list of its two smallest shared pivots only, so
that it counts once though it meets in several.

Pivots grow with the input, about GROWTH times the root of its rows, so that lists of unrelated
vectors stay short: they come from a bounded sample, the SAMPLE times as many valid vectors with
the smallest hash of vec_id, at most MAX_PIVOTS of them, none with a cosine of APART or more to
one before it - else a large group of near copies would take all the pivots. Every vector is
indexed. The index is approximate: candidates that share fewer than two pivots are not looked at;
README has its recall. Vectors of a length that has too few pivots to choose from share one list,
which is exact.

Lists of one vector are dropped on narrow rows, before vectors are sent to lists. Equal vectors
of a label are one class with a multiplicity, so copies cost one entry. A list
longer than BLOCK is cut into blocks by hash; each pair of blocks is a unit of its own, so a
hot list spreads over tasks. A unit yields, per vector, the number of vectors linked, and links
that span what it connects - never its pairs.

Defined results: a vector that is null, empty or zero or holds a null or non-finite component,
and one whose label is null, links with nothing: n_links 0, its own component. Rows with the
same vec_id and different vectors are judged each; equal rows are copies, told by two 64-bit
hashes of label and vector. Empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm.common import components, cut, join_hot, read, ship
from graphloom.llm.vectors import finite, rows_of

NEAREST = 6
GROWTH = 4
MIN_PIVOTS, MAX_PIVOTS = 64, 8192
SAMPLE = 4
APART = 0.9
CUTOFF = 0.98
BLOCK = 1024
VALID = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
#: The list of vectors that have no pivots to choose from.
EVERYTHING = -1


def pivots_for(n: int) -> int:
    return min(MAX_PIVOTS, max(MIN_PIVOTS, GROWTH * isqrt(max(n, 0))))


def pick_pivots(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """By vector length: unit pivots apart from one another, at most n of each, out of SAMPLE * n vectors."""
    got = vectors.where(F.expr(VALID)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE * n).select(F.col("embedding").cast("array<double>").alias("x")).collect()
    by: dict[int, list[np.ndarray]] = {}
    for r in got:
        x = np.array(r["x"])
        by.setdefault(len(x), []).append(x / np.abs(x).max())
    out = {}
    for length, xs in by.items():
        unit = np.stack([x / np.linalg.norm(x) for x in xs])
        kept, k = np.zeros((min(n, len(unit)), length)), 0
        for x in unit:
            if k < n and (not k or (kept[:k] @ x).max() < APART):
                kept[k] = x
                k += 1
        out[length] = kept[:k]
    return out


def _describe(pivots: dict[int, np.ndarray], nearest: int, kind: str):
    """Vectors with their bytes, in their own precision, their prefix as sorted pivot numbers, and their lists; null if they take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, label = rows_of(b.column("embedding")), b.column("label")
            vec, prefix, lists = ([None] * b.num_rows for _ in range(3))
            by: dict[int, list[int]] = {}
            for i, x in enumerate(rows):
                if finite(x) and x.any() and label[i].is_valid:
                    by.setdefault(len(x), []).append(i)
            for length, at in by.items():
                own = pivots.get(length)
                for s in range(0, len(at), 256):  # bounds the products with all pivots
                    some = at[s : s + 256]
                    x = np.stack([rows[i] for i in some]).astype(np.float64) + 0.0  # -0.0 is 0.0
                    for i, bits in zip(some, x.astype(kind), strict=True):
                        vec[i] = bits.tobytes()
                    if own is None or len(own) <= nearest:
                        for i in some:
                            prefix[i], lists[i] = b"", [EVERYTHING]
                        continue
                    near = np.sort(np.argsort(-(x / np.abs(x).max(axis=1)[:, None] @ own.T), axis=1, kind="stable")[:, :nearest], axis=1).astype(np.int32)
                    keys = np.stack([near[:, p].astype(np.int64) << 32 | near[:, q] for p, q in combinations(range(nearest), 2)], axis=1)
                    for r, i in enumerate(some):
                        prefix[i], lists[i] = near[r].tobytes(), keys[r].tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), label, pa.array(vec, pa.binary()), pa.array(prefix, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["vec_id", "label", "vec", "prefix", "lists"]
            )

    return run


def _spanning(link: np.ndarray) -> list[tuple[int, int]]:
    """Positions of links that connect what the symmetric matrix connects."""
    out: list[tuple[int, int]] = []
    left = np.nonzero(link.any(axis=1))[0]
    todo: list[int] = []
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
            continue
        x = todo.pop()
        near = link[x, left]
        found = left[near]
        if len(found):
            left = left[~near]
            out += [(x, int(y)) for y in found]
            todo += found.tolist()
    return out


def first_shared(prefix: np.ndarray, link: np.ndarray, key: int) -> None:
    """Clear what the symmetric matrix links in this list (its two pivots) but meets in an earlier one too: where less than the larger pivot more than one is shared."""
    q = key & 0xFFFFFFFF
    for start in range(0, len(link), 64):
        i, j = np.nonzero(link[start : start + 64])
        i += start
        shared = (prefix[i][:, :, None] == prefix[j][:, None, :]).any(axis=2)
        again = (shared & (prefix[i] < q)).sum(axis=1) > 1
        link[i[again], j[again]] = False


def _judge(cutoff: float, kind: str):
    """Units, sorted, to rows (a, b, n): a link if b is not null, else n vectors linked to a."""

    def unit(list_: int, same: bool, key: np.ndarray, times: np.ndarray, side: np.ndarray, vec: list[bytes], prefix: list[bytes]) -> Iterator[pa.RecordBatch]:
        for n in {len(v) for v in vec}:  # vectors of other lengths don't link
            at = np.array([i for i, v in enumerate(vec) if len(v) == n])
            if len(at) < 2:
                continue
            x = np.frombuffer(b"".join(vec[i] for i in at), kind).astype(np.float64).reshape(len(at), -1)
            x /= np.abs(x).max(axis=1)[:, None]
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            link = (x @ x.T) / (norm[:, None] * norm[None, :]) >= cutoff
            np.fill_diagonal(link, False)
            if not same:
                link &= side[at][:, None] != side[at][None, :]
            if list_ != EVERYTHING and link.any():
                first_shared(np.frombuffer(b"".join(prefix[i] for i in at), np.int32).reshape(len(at), -1), link, list_)
            if not link.any():
                continue
            count = link @ times[at]
            some = np.nonzero(count)[0]
            a, c = key[at][some].tolist(), count[some].tolist()
            spans = _spanning(link)
            k = key[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a + [int(k[i]) for i, _ in spans], pa.int64()), pa.array([None] * len(a) + [int(k[j]) for _, j in spans], pa.int64()), pa.array(c + [0] * len(spans), pa.int64())], ["a", "b", "n"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None

        def settle() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from unit(current[1], current[2] == current[3], t["id"].to_numpy(), t["times"].to_numpy(), t["side"].to_numpy(), t["vec"].to_pylist(), t["prefix"].to_pylist())

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("label", "list", "i", "j")), strict=True))
            s = 0
            while s < len(keys):
                e = s
                while e < len(keys) and keys[e] == keys[s]:
                    e += 1
                if keys[s] != current and held:
                    yield from settle()
                    held = []
                current = keys[s]
                held.append(b.slice(s, e - s))
                s = e
        if held:
            yield from settle()

    return run


def indexed(vectors: DataFrame, pivots: int | None = None, nearest: int = NEAREST, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (vec_id, h1, h2), the hashes null for those that take no part; classes (id, h1, h2, label, first, times, vec, prefix, lists); lists (label, list, n, blocks) of two and more classes."""
    kinds = dict(vectors.dtypes)
    chosen = pick_pivots(vectors, pivots or pivots_for(vectors.count()))
    kind = "f4" if kinds["embedding"] == "array<float>" else "f8"
    described = vectors.mapInArrow(_describe(chosen, nearest, kind), f"vec_id {kinds['vec_id']}, label {kinds['label']}, vec binary, prefix binary, lists array<long>")
    hashes = {"h1": F.xxhash64("label", "vec"), "h2": F.xxhash64(F.lit(1), "vec", "label")}
    described = cut(described.withColumns({name: F.when(F.col("vec").isNotNull(), h) for name, h in hashes.items()}), "vectors")
    first = [F.first(c).alias(c) for c in ("label", "vec", "prefix", "lists")]
    classes = described.where("vec is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("times"), *first)
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")  # written, so ids stay
    listed = classes.select("label", F.explode("lists").alias("list"))
    lists = listed.groupBy("label", "list").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return described.select("vec_id", "h1", "h2"), classes, cut(lists.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "vector-lists")


def near_duplicates(vectors: DataFrame, cutoff: float = CUTOFF, pivots: int | None = None, nearest: int = NEAREST, block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of vectors (vec_id, embedding, label)."""
    ship(vectors.sparkSession)
    vectors = vectors.select("vec_id", F.col("embedding"), "label")
    rows, classes, lists = indexed(vectors, pivots, nearest, block)
    kind = "f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "f8"
    members = classes.select("id", "label", F.explode("lists").alias("list")).join(lists.select("label", "list", "blocks"), ["label", "list"])
    members = members.withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = members.select("id", "label", "list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    units = units.join(classes.select("id", "times", "vec", "prefix"), "id")
    keys = ["label", "list", "i", "j"]
    judged = cut(units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_judge(cutoff, kind), "a long, b long, n long"), "vector-links", compact=True)
    counts = judged.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    linked = components(judged.where("b is not null").select("a", "b"), "vector-links")
    named = linked.join(classes.select(F.col("id").alias("node"), "first"), "node")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    ids = named.join(least, "component").select(F.col("node").alias("id"), "least")
    facts = classes.select("id", "h1", "h2", "first", "times").join(counts, "id", "left").join(ids, "id", "left")
    facts = cut(facts.select("h1", "h2", "times", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id")), "vector-facts")
    own = join_hot(rows.where("h1 is not null"), facts, ["h1", "h2"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    rest = rows.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionAll(rest).withColumn("kept", F.expr("vec_id <=> component_id"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.98
), r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON e.vec_id = c.a LEFT JOIN n ON e.vec_id = n.a
"""
