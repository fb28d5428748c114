"""Retrieval: BM25, exact cosine nearest neighbours, reciprocal-rank fusion, reranking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloom.durable import cut, spread

K1, B = 1.2, 0.75
LONGEST_TOKEN = 40
RRF_K = 60


def analyse(text: Column) -> Column:
    """Lower-cased runs of letters and digits, no longer than 40 bytes."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: (x != "") & (F.octet_length(x) <= LONGEST_TOKEN))


def query_terms(query: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", query.lower()) if t and len(t.encode()) <= LONGEST_TOKEN]


def _times(tokens: Column, word: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == word))


def bm25(docs: DataFrame, doc_id: str, fields: list[str], query: str, limit: int | None = 50) -> DataFrame:
    """(doc_id, score): the sum over fields and query terms; a term asked twice counts twice.

    One scan: per document and field only the length and the query terms' frequencies are
    kept, in a shared table. Sums and document frequencies are one aggregation to a single row;
    nothing is exploded, so cost doesn't depend on vocabulary."""
    terms = query_terms(query)
    if not terms:
        return docs.select(doc_id, F.lit(0.0).alias("score")).limit(0)
    wanted = list(dict.fromkeys(terms))
    one = spread(docs.select(doc_id, *fields)).select(F.col(doc_id), *[analyse(F.coalesce(F.col(f), F.lit(""))).alias(f"t_{f}") for f in fields])
    # tokens are walked once for all terms; what is left of them is short
    met = one.select(doc_id, *[F.size(f"t_{f}").alias(f"len_{f}") for f in fields], *[F.filter(f"t_{f}", lambda x: x.isin(wanted)).alias(f"m_{f}") for f in fields])
    tf = {(f, i): _times(F.col(f"m_{f}"), w) for f in fields for i, w in enumerate(wanted)}
    # text is analysed once; the statistics and the scores both read these narrow rows
    counted = cut(met.select(doc_id, *[f"len_{f}" for f in fields], *[c.alias(f"tf_{f}_{i}") for (f, i), c in tf.items()]))
    totals = counted.agg(
        F.count(F.lit(1)).alias("docs"), *[F.avg(f"len_{f}").alias(f"avg_{f}") for f in fields], *[F.count_if(F.col(f"tf_{f}_{i}") > 0).alias(f"df_{f}_{i}") for f, i in tf]
    )
    score = F.lit(0.0)
    for f, i in tf:
        df, n, t = F.col(f"df_{f}_{i}"), F.col("docs"), F.col(f"tf_{f}_{i}")
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        part = idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col(f"len_{f}") / F.col(f"avg_{f}")))
        score = score + terms.count(wanted[i]) * F.when(t > 0, part).otherwise(0.0)
    hits = counted.where(" or ".join(f"tf_{f}_{i} > 0" for f, i in tf)).join(F.broadcast(totals))  # totals: one row
    out = hits.select(doc_id, F.round(score, 6).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), doc_id).limit(max(limit, 1))


def knn(vectors: DataFrame, vec_id: str, embedding: str, query: list[float], limit: int = 50) -> DataFrame:
    """(vec_id, score): cosine similarity, exact, in doubles; ties to the smaller id. Other lengths don't match."""
    norm = sum(x * x for x in query) ** 0.5
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    own = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    score = F.when((own > 0) & F.lit(norm > 0), dot / (own * F.lit(norm)))
    fits = vectors.where(F.size(embedding) == len(query))
    return fits.select(vec_id, F.round(score, 6).alias("score")).where("score is not null").orderBy(F.desc("score"), vec_id).limit(max(limit, 1))


def rrf(lists: DataFrame, k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """lists (list, chunk_id, symbol_id, score) to (chunk_id, symbol_id, score): the sum of 1 / (k + rank).

    Lists are top-k results, so the ranking window per list is small; the symbol is the first
    list's that knows one."""
    rank = F.row_number().over(W.partitionBy("list").orderBy(F.desc("score"), "chunk_id"))
    ranked = lists.withColumn("rank", rank)
    symbol = F.min(F.when(F.col("symbol_id").isNotNull(), F.struct("list", "symbol_id")))["symbol_id"]
    out = ranked.groupBy("chunk_id").agg(symbol.alias("symbol_id"), F.round(F.sum(1.0 / (max(k, 1) + F.col("rank"))), 6).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "chunk_id").limit(max(limit, 1))


def hybrid(lexical: DataFrame, dense: DataFrame, k: int = RRF_K, limit: int = 30) -> DataFrame:
    """Two hit lists (chunk_id, symbol_id, score) fused."""
    return rrf(lexical.withColumn("list", F.lit("1 lexical")).unionByName(dense.withColumn("list", F.lit("2 dense"))), k, limit)


def rerank(hits: DataFrame, scorer: Column, top_k: int = 20) -> DataFrame:
    """hits (chunk_id, score, ...): the first top_k by score get scorer's score and order; the tail keeps its own."""
    place = F.row_number().over(W.orderBy(F.desc("score"), "chunk_id"))
    ranked = hits.withColumn("place", place)  # a hit list: bounded by its own limit
    head = F.col("place") <= top_k
    scored = ranked.withColumn("head", head).withColumn("score", F.when(head, scorer).otherwise(F.col("score")))
    final = F.row_number().over(W.orderBy(F.desc("head"), F.when(F.col("head"), F.col("score")).desc_nulls_last(), F.when(F.col("head"), F.col("chunk_id")), F.col("place")))
    return scored.withColumn("rank", final).drop("place", "head")


def remove_ids(index: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return index.join(gone.select(key), key, "left_anti")


def upsert(index: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new's rows replace those with the same key."""
    return remove_ids(index, new, key).unionByName(new)


def checked_vectors(vectors: DataFrame, embedding: str, dimension: int) -> DataFrame:
    """vectors, of which one whose length isn't `dimension` is an error when it is read: what an index takes in must fit it."""
    fits = F.size(embedding) == dimension
    wrong = F.raise_error(F.concat(F.lit(f"a vector isn't of length {dimension} but "), F.coalesce(F.size(embedding).cast("string"), F.lit("null"))))
    return vectors.withColumn(embedding, F.when(fits, F.col(embedding)).otherwise(wrong))


def append_vectors(index: DataFrame, new: DataFrame, key: str, embedding: str, dimension: int) -> DataFrame:
    """index with new's rows, which replace those with the same key and must be of its dimension."""
    return upsert(index, checked_vectors(new, embedding, dimension), key)
