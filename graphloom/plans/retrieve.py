"""Context retrieval: ranked layered search over the graph, and packs from search hits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.durable import cut
from graphloom.functions.text import estimate_tokens
from graphloom.operators import graph, pack, rank, search

#: The limits of automatic depth, and what a snippet that can't be read costs.
AUTO_LEAST, AUTO_MOST, FRONTIER, FLOOR, UNREADABLE = 1, 3, 50, 0.12, 100
#: What a hit's own symbol, its parent's and its children's are worth, and how many children.
OWN, PARENT, CHILD, CHILDREN = 1.0, 0.8, 0.7, 5


@dataclass(frozen=True)
class Options:
    mode: str = "neighborhood"
    depth: int | None = None  # None: automatic
    budget: int = 12_000
    max_nodes: int = 200
    max_files: int = 50
    ranking: str = "hybrid"
    include_tests: bool = False
    include_unresolved: bool = False
    kinds: tuple[str, ...] | None = None


def candidates(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, name, qualified_name, path, tokens): symbols as they are ranked; tokens is their snippet's cost."""
    placed = symbols.join(files.select(F.col("id").alias("file_id"), F.col("rel_path").alias("path")), "file_id")
    cost = estimate_tokens(F.col("snippet")) if "snippet" in symbols.columns else F.lit(None).cast("long")
    return placed.select("id", "name", "qualified_name", "path", F.coalesce(cost, F.lit(UNREADABLE)).cast("long").alias("tokens"))


def layered(edges: DataFrame, symbols: DataFrame, files: DataFrame, query: str, options: Options = Options()) -> DataFrame:
    """(id, name, qualified_name, path, tokens, distance, confidence, reason): roots and what is reached from them.

    The loop on the driver handles counts only: a layer is joined, ranked and cut to shared
    files; with automatic depth it keeps the best FRONTIER of those above FLOOR, and ends when a
    layer costs more than what is left of the budget."""
    every = candidates(symbols, files)
    roots = cut(graph.resolve_roots(symbols, files, query).select("id").join(every, "id").select("*", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("confidence"), F.lit("root").alias("reason")), "roots")
    kinds = list(options.kinds or graph.KINDS.get(options.mode, graph.DEFAULT_KINDS))
    used = edges.where(F.col("kind").isin(kinds) & F.col("to_symbol_id").isNotNull())
    if not options.include_unresolved:
        used = used.where(F.col("confidence") != "Unresolved")
    used = cut(used.select("from_symbol_id", "to_symbol_id", "confidence"), "edges")
    auto = options.depth is None
    left = max(options.budget, pack.LEAST_BUDGET) - (roots.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    layers, seen = [roots], roots.select("id")
    for depth in range(AUTO_MOST if auto else options.depth):
        ways = ("in", "out") if options.mode == "impact" and depth == 0 else graph.DIRECTIONS[options.mode]
        here = layers[-1].select(F.col("id").alias("near"), F.col("qualified_name").alias("near_name"))
        found = None
        for way in ways:
            near, far = ("to_symbol_id", "from_symbol_id") if way == "in" else ("from_symbol_id", "to_symbol_id")
            reason = F.concat(F.lit("inbound" if way == "in" else "outbound"), F.lit(" relationship to "), F.col("near_name"))
            own = used.join(here, used[near] == here["near"]).select(F.col(far).alias("id"), F.struct(F.lit(way).alias("way"), F.col("near"), F.col("confidence"), reason.alias("reason")).alias("x"))
            found = own if found is None else found.unionAll(own)
        first = found.groupBy("id").agg(F.min("x").alias("x")).join(seen, "id", "left_anti")
        layer = first.join(every, "id").select("id", "name", "qualified_name", "path", "tokens", F.lit(depth + 1).alias("distance"), F.col("x.confidence").alias("confidence"), F.col("x.reason").alias("reason"))
        layer = cut(layer, "layer")
        seen = seen.unionAll(layer.select("id"))  # what is pruned below stays reached
        if auto:
            ranked = rank.rank(layer, roots, query, options.ranking, include_tests=options.include_tests)
            layer = cut(ranked.where(F.col("score") >= FLOOR).orderBy(*rank.order()).limit(FRONTIER).select(layer.columns), "layer")
            cost = layer.agg(F.sum("tokens")).first()[0]
            if cost is None or cost > left and depth >= AUTO_LEAST:
                break
            left -= cost
        elif layer.isEmpty():
            break
        layers.append(layer)
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out


def graph_pack(edges: DataFrame, symbols: DataFrame, files: DataFrame, query: str, options: Options = Options()) -> DataFrame:
    """(id, qualified_name, path, distance, reason, score, is_root, status): all candidates ranked together, then packed."""
    found = layered(edges, symbols, files, query, options)
    roots = found.where("distance = 0")
    ranked = rank.rank(found, roots, query, options.ranking, include_tests=options.include_tests)
    is_root = F.col("distance") == 0
    place = F.row_number().over(W.orderBy(F.desc("is_root"), *rank.order()))  # candidates are bounded by the search
    placed = cut(ranked.withColumn("is_root", is_root).withColumn("place", place).withColumn("query_id", F.lit(0)), "ranked")
    status = pack.pack(placed, options.budget, options.max_nodes, options.max_files).select("id", "status")
    return placed.join(status, "id").select("id", "qualified_name", "path", "distance", "reason", "score", "is_root", "place", "tokens", "status")


def expand_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (chunk_id, score) to (symbol_id, score, origin): the hit's symbol, its parent chunk's, and its first children's; a symbol's first origin wins."""
    place = F.row_number().over(W.orderBy(F.desc("score"), "chunk_id"))  # a hit list is bounded by its limit
    ranked = hits.select("chunk_id", "score", place.alias("place"))
    c = chunks.select(F.col("id").alias("chunk_id"), "symbol_id", "parent_chunk_id")
    own = ranked.join(c, "chunk_id")
    up = own.join(chunks.select(F.col("id").alias("parent_chunk_id"), F.col("symbol_id").alias("parent_symbol")), "parent_chunk_id")
    down = chunks.where("parent_chunk_id is not null").select(F.col("parent_chunk_id").alias("chunk_id"), F.col("symbol_id").alias("child_symbol"), F.col("id").alias("child"), "start_line").join(ranked, "chunk_id")
    nth = F.row_number().over(W.partitionBy("chunk_id").orderBy("start_line", "child"))
    down = down.withColumn("nth", nth).where(F.col("nth") <= CHILDREN)
    seq = lambda origin, n: F.struct("place", F.lit(origin).alias("origin"), n.alias("n"))
    every = (
        own.select("symbol_id", (F.col("score") * OWN).alias("score"), seq(0, F.lit(0)).alias("seq"))
        .unionAll(up.select(F.col("parent_symbol"), F.col("score") * PARENT, seq(1, F.lit(0))))
        .unionAll(down.select(F.col("child_symbol"), F.col("score") * CHILD, seq(2, F.col("nth"))))
    )
    first = every.where("symbol_id is not null").groupBy("symbol_id").agg(F.min(F.struct("seq", "score")).alias("x"))
    return first.select("symbol_id", F.round("x.score", 6).alias("score"), F.col("x.seq.origin").alias("origin"))


def retrieve(strategy: str, query: str, edges: DataFrame, symbols: DataFrame, files: DataFrame, chunks: DataFrame | None = None, vectors: DataFrame | None = None, query_vector: list[float] | None = None, options: Options = Options(), words: DataFrame | None = None) -> DataFrame:
    """Dispatch by strategy graph, lexical, dense or hybrid; unknown ones are hybrid. Without vectors, hybrid is lexical, and dense has no hits. words (doc, score): hits of a stored lexical index, instead of a scan."""
    if strategy == "graph" or chunks is None:
        return graph_pack(edges, symbols, files, query, options)
    hit = lambda df, key: df.select(F.col(key).alias("chunk_id"), F.lit(None).cast("long").alias("symbol_id"), "score")
    dense = vectors is not None and query_vector is not None
    lexical = None if strategy == "dense" else hit(words if words is not None else search.bm25(chunks.withColumnRenamed("id", "doc"), "doc", ["text", "qualified_name"], query), "doc")
    near = hit(search.knn(vectors, "chunk_id", "vector", query_vector), "chunk_id") if dense and strategy != "lexical" else None
    if lexical is not None and near is not None:
        hits = search.hybrid(lexical, near)
    else:
        hits = lexical if lexical is not None else near if near is not None else hit(chunks.select(F.col("id"), F.lit(0.0).alias("score")).limit(0), "id")
    expanded = expand_hits(hits.select("chunk_id", "score"), chunks)
    every = candidates(symbols, files).join(expanded, F.col("id") == F.col("symbol_id")).drop("symbol_id")
    place = F.row_number().over(W.orderBy(F.desc("score"), F.octet_length("qualified_name"), "id"))
    ranked = every.withColumn("place", place).where(F.col("place") <= options.max_nodes).withColumn("is_root", F.col("place") <= 3).withColumn("query_id", F.lit(0))
    ranked = cut(ranked, "ranked")
    status = pack.pack(ranked, options.budget, options.max_nodes, options.max_files).select("id", "status")
    out = ranked.join(status, "id")
    return out.select("id", "qualified_name", "path", F.col("origin").alias("distance"), F.lit("search hit").alias("reason"), "score", "is_root", "place", "tokens", "status")
