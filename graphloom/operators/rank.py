"""Candidate ranking: by graph, by words, and by both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.text import is_subsequence, is_test_like, is_vendor_like, parent_dir, tokenize

#: What distance and confidence are worth.
DISTANCE = [(0, 10.0), (1, 6.0), (2, 3.0), (3, 1.0)]
CONFIDENCE = [("LspExact", 2.0), ("Syntax", 1.2), ("Heuristic", 0.5), ("Unresolved", -1.0)]


MOST_ROOTS = 1000


def graph_score(roots: DataFrame, include_tests: bool = False) -> Column:
    """Column over candidates (name, qualified_name, path, distance, confidence or null) for roots (path) that are few; with_graph_score takes any number."""
    paths = [r["path"] for r in roots.select("path").where("path is not null").distinct().limit(MOST_ROOTS + 1).collect()]
    if len(paths) > MOST_ROOTS:
        raise ValueError(f"more than {MOST_ROOTS} paths of roots")
    return _graph_score(F.col("path").isin(paths), parent_dir(F.col("path")).isin(sorted({p.rpartition("/")[0] for p in paths})), include_tests)


def with_graph_score(candidates: DataFrame, roots: DataFrame, include_tests: bool = False) -> DataFrame:
    """candidates (name, qualified_name, path, distance, confidence or null) with graph_score; roots (path), however many."""
    paths = roots.select("path").where("path is not null").distinct()
    dirs = paths.select(parent_dir(F.col("path")).alias("_dir")).distinct()
    own = candidates.withColumn("_in", parent_dir(F.col("path")))
    own = own.join(paths.select(F.col("path").alias("_path"), F.lit(True).alias("_file")), F.col("path") == F.col("_path"), "left").join(dirs.withColumn("_near", F.lit(True)), F.col("_in") == F.col("_dir"), "left")
    score = _graph_score(F.coalesce("_file", F.lit(False)), F.coalesce("_near", F.lit(False)), include_tests)
    return own.withColumn("graph_score", score).drop("_in", "_path", "_file", "_dir", "_near")


def _graph_score(same_file: Column, same_dir: Column, include_tests: bool) -> Column:
    score = F.lit(0.0)
    for d, value in DISTANCE:
        score = score + F.when(F.col("distance") == d, value).otherwise(0.0)
    score = score + F.when(same_file, 2.0).when(same_dir, 1.0).otherwise(0.0)
    for c, value in CONFIDENCE:
        score = score + F.when(F.col("confidence") == c, value).otherwise(0.0)
    if not include_tests:
        score = score - F.when(is_test_like(F.col("name"), F.col("qualified_name"), F.col("path")), 2.0).otherwise(0.0)
    return score - F.when(is_vendor_like(F.col("path")), 4.0).otherwise(0.0)


def lexical(candidates: DataFrame, query: str) -> DataFrame:
    """candidates with lexical_score: per query word its IDF among them times the best match in name, qualified name and path."""
    words = candidates.sparkSession.range(1).select(tokenize(F.lit(query)).alias("t")).first()["t"]
    own = candidates
    for c in ("name", "qualified_name", "path"):
        own = own.withColumn(f"_t_{c}", tokenize(F.col(c)))
    has = [(F.array_contains("_t_name", w) | F.array_contains("_t_qualified_name", w) | F.array_contains("_t_path", w)) for w in words]
    totals = own.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(h).alias(f"_df{i}") for i, h in enumerate(has)])
    own = own.join(F.broadcast(totals))  # one row

    def match(tokens: str, w: str, equal: float, prefix: float, within: float | None) -> Column:
        t = F.col(tokens)
        c = F.when(F.array_contains(t, w), equal).when(F.exists(t, lambda x: F.startswith(x, F.lit(w)) | F.startswith(F.lit(w), x)), prefix)
        return (c.when(F.exists(t, lambda x: is_subsequence(F.lit(w), x)), within) if within is not None else c).otherwise(0.0)

    score = F.lit(0.0)
    for i, w in enumerate(words):
        df, n = F.col(f"_df{i}"), F.col("_n")
        idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5) + 1), F.lit(0.1))
        score = score + idf * (match("_t_name", w, 3.0, 1.5, 0.5) + match("_t_qualified_name", w, 2.0, 1.0, 0.3) + match("_t_path", w, 1.0, 0.5, None))
    return own.withColumn("lexical_score", score).drop("_t_name", "_t_qualified_name", "_t_path", "_n", *[f"_df{i}" for i in range(len(words))])


def rank(candidates: DataFrame, roots: DataFrame, query: str, mode: str = "hybrid", graph_weight: float = 1.0, lexical_weight: float = 1.0, include_tests: bool = False) -> DataFrame:
    """candidates with graph_score, lexical_score and score by mode; order by score, then the shorter qualified name, then id."""
    scored = with_graph_score(lexical(candidates, query), roots, include_tests)
    value = {"graph": F.col("graph_score"), "lexical": F.col("lexical_score"), "hybrid": graph_weight * F.col("graph_score") + lexical_weight * F.col("lexical_score")}[mode]
    return scored.withColumn("score", F.round(value, 6)).withColumn("graph_score", F.round("graph_score", 6)).withColumn("lexical_score", F.round("lexical_score", 6))


def order() -> list[Column]:
    return [F.desc("score"), F.octet_length("qualified_name").asc(), F.col("id").asc()]
