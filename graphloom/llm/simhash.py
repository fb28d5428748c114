"""SimHash near-dedup by deletion-variant signatures.

Fingerprints: whole texts, A-Z lower-cased, words joined by one space, every 3-word shingle
(repeats included; fewer words: the whole sequence; none: fingerprint zero), XXH64 with seed
42; a bit is set if it is in over half the hashes.

Search: fingerprints at most DISTANCE = 3 bits apart, cut into two halves of 32 bits, agree
but for at most one bit in one half. Each distinct fingerprint is indexed under 64 keys: for
either half and each of its 32 places, the half with that place as a wildcard. Two halves at
most one bit apart share a key, so an equality join on keys, verified by counting bits, finds
every link. Rows are dealt out and sorted by key, and runs of a key are read as a stream: no
run's pairs are emitted, only links that span what it connects, at most one less than it has
fingerprints. A run longer than LONG_RUN is not held: its members are keyed again, by the
other half cut in two with one wildcard of 16, and dealt out to other tasks; those keys fix 46
of 64 bits.

Documents are classed by fingerprint first, so that copies, however many, are one entry.
Components come from aggregations and joins over links; nothing is gathered on the driver.

Defined results: null and empty texts have fingerprint zero and link with one another; rows
with the same doc_id are each returned; null doc_ids are never the least; an empty table gives
no rows; other columns are ignored by `near_duplicates` and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm.common import components, cut, enter, fresh, join_hot, read, ship, spread

SEED = 42
DISTANCE = 3
LONG_RUN = 8192


def fingerprint(text: bytes) -> int:
    """Of a whole text in UTF-8; unsigned."""
    words = text.lower().split()  # bytes: A-Z only, and just the ASCII white space that parts words
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < 3:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    ones, n = np.zeros(64, np.int64), len(words) - 2
    for i in range(0, n, 65_536):
        j = min(n, i + 65_536)
        h = np.fromiter([digest(joined[s:e], SEED) for s, e in zip(starts[i:j].tolist(), ends[i + 2 : j + 2].tolist(), strict=True)], np.uint64, j - i)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (doc_id, fp): the fingerprint's bits as a signed long."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("simhash")
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(texts[i].as_py() or b"") for i in range(len(texts))), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return spread(docs.select("doc_id", text)).mapInArrow(run, f"doc_id {kind}, fp long")


def spanning_links(v: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Positions (i, j) of links that connect what all links of v connect."""
    links: list[tuple[int, int]] = []
    left = np.arange(1, len(v))
    todo = [0]
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
            continue
        x = todo.pop()
        near = np.bitwise_count(v[left] ^ v[x]) <= distance
        found = left[near]
        if len(found):
            left = left[~near]
            links += [(x, int(y)) for y in found]
            todo += found.tolist()
    return links


def _runs(key: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows, and the end."""
    change = np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1 if len(key) else np.zeros(0, np.int64)
    return np.concatenate([[0], change, [len(key)]]).astype(np.int64)


def _scan(keys: list[str], long_run: int):
    """Links within runs of equal keys in sorted batches; longer runs pass through, unheld (kind 1)."""

    def emit(kind: list, k: list, a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(k, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_v, passing = np.zeros((0, len(keys)), np.int64), np.zeros(0, np.int64), None

        def done(k: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            at = _runs(k)
            size = np.diff(at)
            a: list[int] = []
            b: list[int] = []
            two = at[:-1][size == 2]
            near = two[np.bitwise_count((v[two] ^ v[two + 1]).view(np.uint64)) <= DISTANCE]
            a += v[near].tolist()
            b += v[near + 1].tolist()
            for s, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                own = v[s : s + n]
                for i, j in spanning_links(own.view(np.uint64)):
                    a.append(int(own[i]))
                    b.append(int(own[j]))
            if a:
                yield emit([0] * len(a), [0] * len(a), a, b)

        for batch in batches:
            k = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
            v = batch.column("fp").to_numpy()
            if passing is not None:
                same = (k == passing).all(axis=1)
                n = len(same) if same.all() else int(np.argmin(same))
                if n:
                    yield emit([1] * n, k[:n, 0].tolist(), v[:n].tolist(), [0] * n)
                if n == len(v):
                    continue
                k, v, passing = k[n:], v[n:], None
            k, v = np.concatenate([held_k, k]), np.concatenate([held_v, v])
            last = int(_runs(k)[-2]) if len(k) else 0
            yield from done(k[:last], v[:last])
            held_k, held_v = k[last:], v[last:]
            if len(held_v) > long_run:
                yield emit([1] * len(held_v), held_k[:, 0].tolist(), held_v.tolist(), [0] * len(held_v))
                passing, held_k, held_v = held_k[0].copy(), held_k[:0], held_v[:0]
        yield from done(held_k, held_v)

    return run


SCANNED = "kind int, key long, a long, b long"
#: Place i in 0..63: half i // 32 of the bits with bit i % 32 of it as a wildcard; the place is part of the key.
KEY = "shiftleft(i, 32) | (CASE WHEN i < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END & ~shiftleft(1L, CAST(i % 32 AS INT)))"
#: The other half's quarters, for members of a long run: place j in 0..31.
SUBKEY = (
    "shiftleft(j, 32) | (shiftrightunsigned(CASE WHEN shiftrightunsigned(key, 32) < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END, CASE WHEN j < 16 THEN 0 ELSE 16 END)"
    " & 65535L & ~shiftleft(1L, CAST(j % 16 AS INT)))"
)


def links(fps: DataFrame, long_run: int = LONG_RUN) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints fps (fp) that are DISTANCE or fewer bits apart."""
    ship(fps.sparkSession)
    keyed = fps.select("fp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("i")).select(F.expr(KEY).alias("key"), "fp")
    found = cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_scan(["key"], long_run), SCANNED), "simhash-links", compact=True)
    out = found.where("kind = 0").select("a", "b")
    if not found.where("kind = 1").isEmpty():
        again = found.where("kind = 1").select("key", F.col("a").alias("fp"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))).alias("j")).select("key", F.expr(SUBKEY).alias("sub"), "fp")
        rest = again.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(_scan(["key", "sub"], 1 << 62), SCANNED)
        out = out.unionAll(cut(rest.select("a", "b"), "simhash-links"))
    return out


def grouped(own: DataFrame, long_run: int = LONG_RUN) -> DataFrame:
    """Rows (fp, times, component, component_id) of rows (doc_id, fp): component names the group by one of its fingerprints."""
    classes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("times")), "simhash-classes")
    linked = components(links(classes.select("fp"), long_run), "simhash-links")
    linked = cut(linked.join(classes, F.col("node") == F.col("fp")).select("fp", "first", "component"), "simhash-linked")
    least = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    named = linked.join(least, "component").select("fp", "component", "component_id")
    return cut(classes.join(named, "fp", "left").select("fp", "times", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "first").alias("component_id")), "simhash-named")


def near_duplicates(docs: DataFrame, text: str = "text", long_run: int = LONG_RUN) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of docs."""
    own = cut(fingerprints(docs, text), "simhash", compact=True)
    return join_hot(own, grouped(own, long_run), ["fp"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one row of each component: the least doc_id (null only where there is no other), of several rows with it one text's; rows that repeat id and text stay once."""
    k = fresh(docs.columns, "_row")
    keyed = docs.withColumn(k, F.xxhash64("doc_id", text))
    own = fingerprints(keyed.select(F.struct("doc_id", F.col(k).alias("k")).alias("doc_id"), text), text)
    own = cut(own.select("doc_id.doc_id", "doc_id.k", "fp"), "simhash", compact=True)
    found = join_hot(own, grouped(own.select("doc_id", "fp")), ["fp"])
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k")).alias("x"))
    first = cut(first.select(F.col("x.k").alias(k)), "simhash-kept")
    return keyed.join(first.hint("shuffle_hash"), k, "left_semi").dropDuplicates([k]).select(docs.columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
