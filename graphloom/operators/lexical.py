"""A lexical index that stays on disk: postings by term, so that a search reads its terms only.

An index is a folder of segments. A segment has `postings` (bucket, term, field, doc, tf, len),
in a directory per bucket of the term's hash and sorted by term, `docs` (doc, len_<field>...),
`dead` (doc) and `totals`, one row of how many documents and tokens it adds to or takes from the
index. A marker makes it visible whole. A document's rows in a segment hold until a later segment
names it dead: replaced documents are dead in the segment that brings their new rows.

A search prunes to its terms' buckets, pushes the terms down to the sorted files, and takes
lengths from the postings and statistics from the totals, so it reads no text and no other term.
A term in most documents has a bucket of many files: postings are rebalanced when written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from graphloom.durable import spread
from graphloom.operators.search import K1, B, analyse, query_terms

#: Text that one bucket's postings stand for, and the fewest and most buckets.
BUCKET_BYTES, FEWEST, MOST = 256 << 20, 16, 4096


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def segments(spark: SparkSession, root: str) -> list[tuple[int, str, int]]:
    """Visible segments in order: number, folder, number of buckets."""
    fs, at = _fs(spark, f"{root}/segments")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName().split("=") for s in fs.listStatus(at) if s.getPath().getName().count("=") == 2]
    return sorted((int(n), f"{root}/{folder}", int(buckets)) for n, folder, buckets in names)


def clear(spark: SparkSession, root: str) -> None:
    fs, at = _fs(spark, root)
    fs.delete(at, True)


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, root: str, table: str, only: set[int] | None = None) -> DataFrame | None:
    """A table of all segments, with the segment's number."""
    out = None
    for n, folder, _ in segments(spark, root):
        if only is None or n in only:
            one = spark.read.parquet(f"{folder}/{table}").withColumn("segment", F.lit(n))
            out = one if out is None else out.unionByName(one)
    return out


def _add(spark: SparkSession, root: str, docs: DataFrame | None, doc_id: str, fields: list[str], gone: DataFrame | None, buckets: int | None) -> None:
    known = segments(spark, root)
    n = known[-1][0] + 1 if known else 0
    folder = f"segment-{n}-{uuid.uuid4().hex[:12]}"
    at = f"{root}/{folder}"
    buckets = buckets or (known[-1][2] if known else None)
    if buckets is None:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        buckets = min(MOST, max(FEWEST, size // BUCKET_BYTES)) if size < 1 << 50 else FEWEST
    kind = dict(docs.dtypes)[doc_id] if docs is not None else dict(spark.read.parquet(f"{known[0][1]}/docs").dtypes)["doc"]
    if docs is None:
        docs = spark.createDataFrame([], f"{doc_id} {kind}, " + ", ".join(f"{f} string" for f in fields))
    tokens = spread(docs.select(F.col(doc_id).alias("doc"), *fields)).select("doc", *[analyse(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in fields])
    tokens.select("doc", *[F.size(f).cast("long").alias(f"len_{f}") for f in fields]).write.parquet(f"{at}/docs")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("terms"), F.size(f).cast("long").alias("len")) for f in fields]))
    terms = tokens.select("doc", each.alias("x")).select("doc", "x.field", "x.len", F.explode("x.terms").alias("term"))
    counted = terms.groupBy("doc", "field", "len", "term").agg(F.count(F.lit(1)).alias("tf")).withColumn("bucket", _bucket(F.col("term"), buckets))
    counted.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "field", "doc").write.partitionBy("bucket").parquet(f"{at}/postings")
    dead = spark.createDataFrame([], f"doc {kind}") if gone is None else gone.select(F.col(doc_id).cast(kind).alias("doc")).distinct()
    dead.write.parquet(f"{at}/dead")
    sums = [F.coalesce(F.sum(f"len_{f}"), F.lit(0)).cast("long").alias(f"len_{f}") for f in fields]
    added = spark.read.parquet(f"{at}/docs").agg(F.count(F.lit(1)).alias("docs"), *sums)
    if known and gone is not None:
        taken = live_docs(spark, root).join(spark.read.parquet(f"{at}/dead"), "doc", "left_semi").agg(F.count(F.lit(1)).alias("docs"), *sums)
        added = added.unionAll(taken.select(*[(-F.col(c)).alias(c) for c in taken.columns])).agg(*[F.sum(c).cast("long").alias(c) for c in added.columns])
    added.coalesce(1).write.parquet(f"{at}/totals")
    fs, marker = _fs(spark, f"{root}/segments/{n}={folder}={buckets}")
    fs.create(marker, True).close()


def build(docs: DataFrame, doc_id: str, fields: list[str], root: str, buckets: int | None = None) -> None:
    """Index docs anew: what was under root goes."""
    clear(docs.sparkSession, root)
    _add(docs.sparkSession, root, docs, doc_id, fields, None, buckets)


def upsert(docs: DataFrame, doc_id: str, fields: list[str], root: str) -> None:
    """Add documents; those already indexed under the same id are replaced."""
    _add(docs.sparkSession, root, docs, doc_id, fields, docs.select(doc_id), None)


def remove(gone: DataFrame, doc_id: str, fields: list[str], root: str) -> None:
    _add(gone.sparkSession, root, None, doc_id, fields, gone, None)


def _buried(spark: SparkSession, root: str) -> DataFrame | None:
    """(doc, until): rows of a document in segments before `until` are dead; None: no segment but the first."""
    later = {n for n, _, _ in segments(spark, root)[1:]}
    dead = _read(spark, root, "dead", later) if later else None
    return None if dead is None else dead.groupBy("doc").agg(F.max("segment").alias("until"))


def _live(rows: DataFrame, buried: DataFrame | None) -> DataFrame:
    if buried is None:
        return rows
    return rows.join(buried, "doc", "left").where(F.col("until").isNull() | (F.col("segment") >= F.col("until"))).drop("until")


def live_docs(spark: SparkSession, root: str) -> DataFrame:
    """(doc, len_<field>..., segment) of the documents that a search can find."""
    return _live(_read(spark, root, "docs"), _buried(spark, root))


def count(spark: SparkSession, root: str) -> int:
    """How many documents the index has, from its totals."""
    totals = _read(spark, root, "totals")
    return 0 if totals is None else totals.agg(F.sum("docs")).first()[0] or 0


def search(spark: SparkSession, root: str, query: str, limit: int | None = 50, doc_id: str = "doc") -> DataFrame:
    """(doc, score): BM25 as `search.bm25` has it, summed over fields and query terms; a term asked twice counts twice."""
    terms = query_terms(query)
    wanted = list(dict.fromkeys(terms))
    known = segments(spark, root)
    if not known:
        raise FileNotFoundError(f"no lexical index under {root}")
    kind = spark.read.parquet(f"{known[0][1]}/docs").schema["doc"].dataType
    schema = T.StructType([T.StructField("doc", kind), *[T.StructField(n, t) for n, t in (("field", T.StringType()), ("len", T.LongType()), ("term", T.StringType()), ("tf", T.LongType()), ("bucket", T.IntegerType()))]])
    # the query's own words, hashed by Spark; all segments of an index have as many buckets
    at = [r[0] for r in spark.range(1).select(F.explode(F.array(*[_bucket(F.lit(w), known[0][2]) for w in wanted])).alias("b")).distinct().collect()] if wanted else []
    out = None
    for n, folder, _ in known:
        own = spark.read.schema(schema).parquet(f"{folder}/postings").where(F.col("bucket").isin(at) & F.col("term").isin(wanted)).withColumn("segment", F.lit(n))
        out = own if out is None else out.unionByName(own)
    hits = _live(out.drop("bucket"), _buried(spark, root))
    totals = _read(spark, root, "totals").drop("segment")
    fields = [c[4:] for c in totals.columns if c.startswith("len_")]
    # statistics are a row per field, and a row per term and field: bounded by the query
    sums = totals.agg(*[F.sum(c).alias(c) for c in totals.columns])
    stats = sums.select("docs", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f"len_{f}") / F.col("docs")).alias("avg")) for f in fields])).alias("x")).select("docs", "x.field", "x.avg")
    df = hits.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))
    times = F.create_map(*[x for w in wanted for x in (F.lit(w), F.lit(terms.count(w)))]) if wanted else F.create_map(F.lit(""), F.lit(0))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    scored = hits.join(F.broadcast(df.join(stats, "field")), ["term", "field"]).select("doc", (part * F.element_at(times, F.col("term"))).alias("part"))
    found = scored.groupBy(F.col("doc").alias(doc_id)).agg(F.round(F.sum("part"), 6).alias("score"))
    return found if limit is None else found.orderBy(F.desc("score"), doc_id).limit(max(limit, 1))
