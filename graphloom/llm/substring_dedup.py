"""Substring dedup over Rabin-Karp hashes of every fixed-length token window.

A window is WIDTH consecutive words of one document. A word goes if a window that covers it has
a word sequence that also starts in a document with a smaller doc_id; windows are judged on
the input. Windows that go merge into maximal removal intervals.

Hashes: each word's XXH64, combined over the window as a polynomial modulo 2**64 and finalised,
twice, with two bases. The first hash is a window's 64-bit key; the top bits of the second are
its bucket, so that windows are one only if 64 bits and the bucket agree. Of n windows about
n**2 / 2**(65 + bits) pairs collide: 1e-6 at 0.5 GB of input (6 bits), some 50 of 1.6e13 windows
at 100 TB (17 bits).

Plan: map tasks take groups of about GROUP words. Within a group a hash is first reduced to its
least doc_id: windows of later documents become removal intervals at once, so a passage that a
third of all documents share sends one entry per group, not per document. What is left travels
with its doc_id as arrays, one row per group and bucket, and becomes a Spark row per window
behind the shuffle: Spark sorts the rows of a bucket by hash and takes each hash's least doc_id,
spilling as it needs. No Python worker holds a bucket, and places needn't travel: a document is
sent the hashes that it loses and finds their places in its own text. These hashes and intervals
are grouped by document, which bounds them by the document's length, and join the documents.

Defined results: null text has no words; rows with the same doc_id don't mark one another, and
are told apart by a key of their text; null doc_ids take no part and lose nothing; documents
shorter than a window lose nothing; an empty table gives no rows; other columns pass through
`remove`.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from graphloom.llm.common import enter, fresh, read, ship, spread, text_bytes, trim

WIDTH = 13
GROUP = 500_000
BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BUCKET_BYTES = 8 << 20
FEWEST_BITS, MOST_BITS = 6, 17


def words_of(text: bytes) -> list[bytes]:
    return text.split()  # bytes: just the ASCII white space that parts words


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, width: int, base: np.uint64 = BASES[0]) -> np.ndarray:
    """Of every place from which a window fits into the array; words: their hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, width):
        h *= base
        h += words[j : j + n]
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def bucket_of(words: np.ndarray, width: int, bits: int) -> np.ndarray:
    return (window_hashes(words, width, BASES[1]) >> np.uint64(64 - bits)).astype(np.int32)


def merged(places: np.ndarray, width: int) -> np.ndarray:
    """Maximal intervals that windows at these sorted places cover, each as start << 32 | end."""
    if not len(places):
        return np.zeros(0, np.int64)
    first = np.concatenate([[True], places[1:] > places[:-1] + width])
    last = np.concatenate([first[1:], [True]])
    return places[first].astype(np.int64) << 32 | (places[last] + width).astype(np.int64)


#: kind 0: windows (docs, hashes, and texts' keys where ids repeat) of a bucket; kind 1: intervals that one document loses.
PACKED = "kind int, bucket int, docs array<long>, hashes array<long>, keys array<long>"
SPANS = 1


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _packed(kind: int, buckets: list[int], docs: list[np.ndarray], hashes: list[np.ndarray], keys: list[np.ndarray] | None) -> pa.RecordBatch:
    n = len(buckets)
    own = _lists(keys) if keys is not None else pa.nulls(n, pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(buckets, pa.int32()), _lists(docs), _lists(hashes), own], ["kind", "bucket", "docs", "hashes", "keys"])


def _text_key(text: bytes) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text, 42)).astype(np.int64))  # Spark's xxhash64(text)


def _windows(width: int, bits: int, keyed: bool):
    """Texts to packed windows, and to the intervals that go within the group."""

    def group(ids: list[int], hashed: list[np.ndarray], keys: list[int]) -> Iterator[pa.RecordBatch]:
        doc_id, text_key = np.array(ids, np.int64), np.array(keys, np.int64)
        n = np.array([len(x) for x in hashed])
        starts = np.cumsum(n) - n
        fits = n - width + 1
        words = np.concatenate(hashed)
        row = np.repeat(np.arange(len(n)), fits)
        place = np.arange(int(fits.sum())) - np.repeat(np.cumsum(fits) - fits, fits)
        at = place + starts[row]
        h, bucket = window_hashes(words, width)[at], bucket_of(words, width, bits)[at]
        del words, at
        doc = doc_id[row]
        order = np.argsort(h)
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        if (bucket[order][1:] != bucket[order][:-1])[~new[1:]].any():  # a collision of the first hash
            order = np.lexsort((bucket, h))
            new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])])
        runs = np.nonzero(new)[0]
        least = np.minimum.reduceat(doc[order], runs)
        later = np.empty(len(h), bool)
        later[order] = doc[order] > np.repeat(least, np.diff(np.append(runs, len(h))))
        if later.any():
            gone_row, gone_place = row[later], place[later]  # in order of row and place
            cuts = np.concatenate([[0], np.nonzero(np.diff(gone_row))[0] + 1, [len(gone_row)]])
            spans = [merged(gone_place[s:e], width) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            own = gone_row[cuts[:-1]]
            home = ((doc_id[own].astype(np.uint64) * BASES[0]) >> np.uint64(64 - bits)).astype(np.int64).tolist()
            yield _packed(SPANS, home, [np.full(len(x), d) for x, d in zip(spans, doc_id[own].tolist(), strict=True)], spans, [np.full(len(x), k) for x, k in zip(spans, text_key[own].tolist(), strict=True)] if keyed else None)
        # one entry for each hash; where ids repeat, all of its least document, whose rows differ
        take = np.nonzero(~later)[0] if keyed else _first_of_least(order, runs, later)
        b = bucket[take]
        take = take[np.lexsort((doc[take], b))]
        b = bucket[take]
        cuts = np.concatenate([[0], np.nonzero(np.diff(b))[0] + 1, [len(take)]]).tolist()
        for k in range(0, len(cuts) - 1, 2048):
            some = list(zip(cuts[k : k + 2048], cuts[k + 1 : k + 2049], strict=False))
            parts = [take[s:e] for s, e in some]
            yield _packed(0, [int(b[s]) for s, _ in some], [doc[p] for p in parts], [h[p].view(np.int64) for p in parts], [text_key[row[p]] for p in parts] if keyed else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substring dedup")
        ids: list[int] = []
        hashed: list[np.ndarray] = []
        keys: list[int] = []
        held = 0
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for i, doc in enumerate(b.column(0).to_pylist()):
                text = texts[i].as_py()
                if text is None or doc is None:
                    continue
                words = words_of(text)
                if len(words) < width:
                    continue
                ids.append(doc)
                hashed.append(word_hashes(words))
                keys.append(_text_key(text) if keyed else 0)
                held += len(words)
                if held >= GROUP:
                    yield from group(ids, hashed, keys)
                    ids, hashed, keys, held = [], [], [], 0
                    trim()
        if ids:
            yield from group(ids, hashed, keys)

    return run


def _first_of_least(order: np.ndarray, runs: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Of each run of equal hashes, one entry of its least document."""
    stays = np.nonzero(~later[order])[0]
    return order[stays[np.searchsorted(stays, runs)]]


def marks(docs: DataFrame, text: str = "text", width: int = WIDTH, keyed: bool = False) -> DataFrame:
    """Rows (doc_id, text_key, hashes, spans): the hashes of windows that a document loses, and intervals of words that it loses as start << 32 | end; documents that lose nothing have none."""
    ship(docs.sparkSession)
    bits = min(MOST_BITS, max(FEWEST_BITS, (text_bytes(docs, text) // BUCKET_BYTES).bit_length()))
    packed = spread(docs.select(F.col("doc_id").cast("long"), text)).mapInArrow(_windows(width, bits, keyed), PACKED).repartitionById(1 << bits, "bucket")
    rows = packed.select("kind", "bucket", F.inline(F.arrays_zip("docs", "hashes", "keys") if keyed else F.arrays_zip("docs", "hashes")))
    # the hash leads the sort; intervals pass through
    least = F.min("docs").over(W.partitionBy("hashes", "bucket", "kind"))
    lost = rows.withColumn("least", least).where((F.col("kind") == SPANS) | (F.col("docs") > F.col("least")))
    key = F.col("keys") if keyed else F.lit(0).cast("long")
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("hashes")))  # noqa: E731  leaves out nulls
    return lost.groupBy(F.col("docs").alias("doc_id"), key.alias("text_key")).agg(of(0).alias("hashes"), of(SPANS).alias("spans"))


def lost_words(words: list[bytes], hashes: np.ndarray, spans: np.ndarray, width: int) -> np.ndarray:
    """By word: it goes."""
    gone = np.zeros(len(words), bool)
    for span in spans.tolist():
        gone[span >> 32 : span & 0xFFFFFFFF] = True
    if len(hashes):
        places = np.nonzero(np.isin(window_hashes(word_hashes(words), width), hashes.view(np.uint64)))[0]
        for span in merged(places, width).tolist():
            gone[span >> 32 : span & 0xFFFFFFFF] = True
    return gone


def _cut_words(text: bytes | None, hashes, spans, width: int) -> tuple[int, list[bytes]]:
    words = words_of(text or b"")
    if not hashes.is_valid or not len(words):
        return len(words), words
    gone = lost_words(words, *(x.values.to_numpy() for x in (hashes, spans)), width)
    return len(words), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _apply(docs: DataFrame, text: str, width: int, out: T.StructType, make) -> DataFrame:
    """make(row batch, [(n words, kept words)]) over docs joined with what they lose."""
    ids = docs.select("doc_id").where("doc_id is not null").groupBy("doc_id").count()
    keyed = not ids.where("count > 1").isEmpty()
    doc, key, own, also = (fresh(docs.columns, c) for c in ("_doc", "_key", "_hashes", "_spans"))
    on = docs["doc_id"].cast("long") == F.col(doc)
    if keyed:
        on &= F.xxhash64(text) == F.col(key)
    found = marks(docs, text, width, keyed).select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("hashes").alias(own), F.col("spans").alias(also))
    joined = docs.join(found.hint("shuffle_hash"), on, "left").select(*[docs[f"`{c}`"] for c in docs.columns], own, also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, hashes, spans = b.column(text).cast(pa.binary()), b.column(own), b.column(also)
            yield make(b, (_cut_words(texts[i].as_py(), hashes[i], spans[i], width) for i in range(b.num_rows)))

    return joined.mapInArrow(run, out)


def remove(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with the kept words, joined by one space, as text (null stays null), plus _n_words and _n_removed, which replace any of those names."""
    docs = docs.drop("_n_words", "_n_removed")
    names = docs.columns
    schema = T.StructType([*docs.schema, T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType())])

    def make(b: pa.RecordBatch, rows) -> pa.RecordBatch:
        rows = list(rows)
        null = b.column(text).is_null().to_pylist()
        columns = [pa.array([None if x else b" ".join(w).decode() for x, (_, w) in zip(null, rows, strict=True)], pa.string()) if c == text else b.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array([n for n, _ in rows], pa.int64()), pa.array([n - len(w) for n, w in rows], pa.int64())], [*names, "_n_words", "_n_removed"])

    return _apply(docs, text, width, schema, make)


def digests(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256)."""
    docs = docs.select("doc_id", text)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def make(b: pa.RecordBatch, rows) -> pa.RecordBatch:
        n, gone, kept = [], [], []
        for count, words in rows:
            n.append(count)
            gone.append(count - len(words))
            kept.append(sha256(b" ".join(words)).hexdigest())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _apply(docs, text, width, schema, make)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM t
), k AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER f AS win, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING)
), g AS (SELECT doc_id, pos FROM (SELECT *, min(doc_id) OVER (PARTITION BY win) AS least FROM k WHERE n = {WIDTH}) WHERE least < doc_id
), c AS (SELECT DISTINCT doc_id, pos + j AS pos FROM g, range({WIDTH}) AS r(j)
), a AS (
  SELECT w.doc_id, count(*) AS n_words, count(c.pos) AS n_removed, string_agg(word, ' ' ORDER BY w.pos) FILTER (c.pos IS NULL) AS kept
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id AND w.pos = c.pos GROUP BY w.doc_id
)
SELECT t.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN a ON t.doc_id = a.doc_id
"""
