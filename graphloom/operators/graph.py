"""The property graph: name resolution, containment, metrics, expansion and traversal."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloom.durable import Layers, cut
from graphloom.functions.text import callee_name, file_name, is_method_call, stem, tokenize
from graphloom.sources.schemas import CONTAINER_KINDS

#: Directions and edge kinds by traversal mode.
DIRECTIONS = {
    "callers": ("in",), "dependents": ("in",), "reverse_slice": ("in",), "reverse": ("in",),
    "callees": ("out",), "dependencies": ("out",), "forward_slice": ("out",), "forward": ("out",),
    "neighborhood": ("in", "out"), "impact": ("in",),
}
DEFAULT_KINDS = ["Call", "Reference", "Import", "Export", "TypeUse", "Inherits", "Implements", "DataFlow", "Contains"]
KINDS = {
    "callers": ["Call", "Reference"], "callees": ["Call", "Reference"],
    "dependencies": ["Import", "Call", "TypeUse", "Reference"], "dependents": ["Import", "Call", "TypeUse", "Reference"],
}


def resolve_names(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """One Call edge per enclosed call; the target is set if just one symbol of a fitting kind has the name.

    Candidates are counted per (name, method or not) before the join, so an ambiguous name costs
    one row on the build side however many symbols share it."""
    calls = occurrences.where((F.col("kind") == "Call") & F.col("enclosing_symbol_id").isNotNull()).withColumn("callee", callee_name(F.col("raw_text"))).withColumn("as_method", is_method_call(F.col("raw_text")))
    named = symbols.where(F.col("kind").isin("Function", "Method", "Test")).select("name", F.explode(F.when(F.col("kind") == "Method", F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("as_method"), "id", "file_id")
    unique = named.groupBy(F.col("name").alias("callee"), "as_method").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("target"), F.min("file_id").alias("target_file")).where("n = 1")
    joined = calls.join(unique, ["callee", "as_method"], "left")
    confidence = F.when(F.col("target").isNull(), "Unresolved").when(F.col("target_file") == F.col("file_id"), "Syntax").otherwise("Heuristic")
    return joined.select(F.col("id").alias("occurrence_id"), F.lit("Call").alias("kind"), F.col("enclosing_symbol_id").alias("from_symbol_id"), F.col("target").alias("to_symbol_id"), "raw_text", confidence.alias("confidence"))


def call_edges(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """resolve_names with edge ids made of the occurrence."""
    return resolve_names(occurrences, symbols).withColumn("id", F.xxhash64(F.lit("Call"), "occurrence_id"))


def nested_edges(contains: DataFrame) -> DataFrame:
    """Contains edges (parent_id, child_id) in the shape of call_edges."""
    none = lambda kind: F.lit(None).cast(kind)
    return contains.select(
        none("long").alias("occurrence_id"), F.lit("Contains").alias("kind"), F.col("parent_id").alias("from_symbol_id"), F.col("child_id").alias("to_symbol_id"), none("string").alias("raw_text"),
        F.lit("Syntax").alias("confidence"), F.xxhash64(F.lit("Contains"), "child_id").alias("id"),
    )


def _sweep(rows: DataFrame, order: list[str], step: Callable[[], Callable[..., int | None]], out: tuple[str, str]) -> DataFrame:
    """Rows (file, id, ...) in order within their file, one after the other, to pairs (step's answer, id) where it has one.

    A task streams whole files in order and holds what step keeps, not a file; step starts anew for each."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, own = object(), None
        for b in batches:
            found: list[int] = []
            ids: list[int] = []
            for row in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if row[0] != file:
                    file, own = row[0], step()
                answer = own(*row[1:])
                if answer is not None:
                    found.append(answer)
                    ids.append(row[1])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(ids, pa.int64())], list(out))

    return rows.repartition(names[0]).sortWithinPartitions(names[0], *[F.expr(c.split()[0]).desc_nulls_last() if c.endswith(" desc") else c for c in order]).mapInArrow(run, f"{out[0]} long, {out[1]} long")


def contains_edges(symbols: DataFrame) -> DataFrame:
    """(parent_id, child_id): per file, a symbol's parent is the last container that starts before it and hasn't ended.

    Order: start, then the longer first, then id. One sweep over a file's symbols with a stack of
    open containers: linear in the file, and no pairs of containers and symbols are made."""
    rows = symbols.select("file_id", F.col("id").cast("long").alias("id"), F.col("start_line").cast("long").alias("start"), F.col("end_line").cast("long").alias("end"), F.col("kind").isin(CONTAINER_KINDS).alias("container"), (-F.col("end_line")).alias("longer"))

    def step() -> Callable[..., int | None]:
        opened: list[tuple[int, int]] = []

        def next_symbol(id_: int, start: int | None, end: int | None, container: bool, _longer: int | None) -> int | None:
            if start is None or end is None:
                return None
            while opened and opened[-1][0] < start:
                opened.pop()
            parent = opened[-1][1] if opened else None
            if container:
                opened.append((end, id_))
            return parent

        return next_symbol

    return _sweep(rows, ["start", "longer", "id"], step, ("parent_id", "child_id"))


def match_definitions(locations: DataFrame, symbols: DataFrame) -> DataFrame:
    """(occurrence_id, symbol_id): the smallest symbol whose range holds the location but whose body doesn't.

    What of a symbol's range isn't its body is one or two intervals; one sweep over a file's
    intervals and locations by line keeps the open ones in a heap by size, so no pairs are made."""
    start, end, body, last = (F.col(c) for c in ("start_line", "end_line", "body_start_line", "body_end_line"))
    whole = body.isNull() | last.isNull() | (body > last)
    part = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    parts = F.when(whole, F.array(part(start, end))).otherwise(F.array(part(start, F.least(end, body - 1)), part(F.greatest(start, last + 1), end)))
    open_ = symbols.select("file_id", F.col("id").cast("long").alias("id"), (end - start).cast("long").alias("size"), F.explode(parts).alias("p")).where("p.a <= p.b")
    open_ = open_.select("file_id", "id", F.col("p.a").alias("line"), F.col("p.b").alias("until"), "size")
    asked = locations.select("file_id", F.col("occurrence_id").cast("long").alias("id"), F.col("line").cast("long").alias("line"), F.lit(None).cast("long").alias("until"), F.lit(None).cast("long").alias("size")).where("line is not null")

    def step() -> Callable[..., int | None]:
        heap: list[tuple[int, int, int]] = []

        def next_row(id_: int, line: int, until: int | None, size: int | None) -> int | None:
            if until is not None:
                heapq.heappush(heap, (size, id_, until))
                return None
            while heap and heap[0][2] < line:
                heapq.heappop(heap)
            return heap[0][1] if heap else None

        return next_row

    # intervals that start on a line come before the locations on it
    swept = _sweep(open_.unionByName(asked), ["line", "until desc", "id"], step, ("symbol_id", "occurrence_id"))
    return swept.select("occurrence_id", "symbol_id")


def upgrade_edges(edges: DataFrame, matched: DataFrame) -> DataFrame:
    """Edges that a language server resolved take its target and the exact confidence; others stay."""
    m = matched.select("occurrence_id", F.col("symbol_id").alias("exact_id"))
    hit = F.col("exact_id").isNotNull() & (F.col("confidence") != "LspExact")
    return edges.join(m, "occurrence_id", "left").withColumn("to_symbol_id", F.when(hit, F.col("exact_id")).otherwise(F.col("to_symbol_id"))).withColumn("confidence", F.when(hit, "LspExact").otherwise(F.col("confidence"))).drop("exact_id")


def fan(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) over Call edges."""
    calls = edges.where("kind = 'Call'")
    into = calls.groupBy(F.col("to_symbol_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    out = calls.groupBy(F.col("from_symbol_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    return symbols.select("id").join(into, "id", "left").join(out, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def coupling(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, coupling): different qualified names of containers that a symbol's edges lead to."""
    to = symbols.where(F.col("kind").isin(CONTAINER_KINDS)).select(F.col("id").alias("to_symbol_id"), "qualified_name")
    found = edges.where("from_symbol_id <> to_symbol_id").join(to, "to_symbol_id").groupBy(F.col("from_symbol_id").alias("id")).agg(F.countDistinct("qualified_name").alias("n"))
    return symbols.select("id").join(found, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("coupling"))


#: Pairs of methods under one class's references, counted with repeats, up to which pairs are made; beyond it sets of methods are united.
MOST_PAIRS = 100_000


def lcom(symbols: DataFrame, occurrences: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(id, cohesion) of classes and structs: pairs of methods without a shared reference, less those with one, at least 0.

    A class of m methods has m(m-1)/2 pairs; those that share a reference are counted as distinct
    pairs where the class has few. In a class with a hot reference no pairs are made: per
    reference the class's methods are a bitmap, a method's neighbours are the union of its
    references' bitmaps, and their number halved, without itself, is the count. Both ways are
    exact."""
    classes = symbols.where(F.col("kind").isin("Class", "Struct")).select("id")
    methods = symbols.where("kind = 'Method'").select(F.col("id").alias("method_id"), F.col("parent_symbol_id").alias("class_id")).join(classes.select(F.col("id").alias("class_id")), "class_id", "left_semi")
    refs = cut(occurrences.select(F.col("enclosing_symbol_id").alias("method_id"), "raw_text").distinct().join(methods, "method_id").select("class_id", "method_id", "raw_text"))
    shared = refs.groupBy("class_id", "raw_text").agg(F.count(F.lit(1)).alias("g")).where("g > 1")
    load = cut(shared.groupBy("class_id").agg(F.sum(F.col("g") * (F.col("g") - 1) / 2).alias("pairs")).select("class_id", (F.col("pairs") > most_pairs).alias("hot")))
    few = refs.join(load.where("not hot"), "class_id", "left_semi")
    a, b = few.alias("a"), few.alias("b")
    on = (F.col("a.class_id") == F.col("b.class_id")) & (F.col("a.raw_text") == F.col("b.raw_text")) & (F.col("a.method_id") < F.col("b.method_id"))
    overlap = a.join(b, on).select("a.class_id", F.col("a.method_id").alias("m1"), F.col("b.method_id").alias("m2")).distinct().groupBy("class_id").agg(F.count(F.lit(1)).alias("q"))
    if not load.where("hot").isEmpty():
        many = refs.join(load.where("hot"), "class_id", "left_semi")
        number = many.select("class_id", "method_id").distinct().withColumn("n", F.row_number().over(W.partitionBy("class_id").orderBy("method_id")).cast("long"))
        many = many.join(number, ["class_id", "method_id"])
        sets = many.groupBy("class_id", "raw_text", F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))
        near = many.join(sets, ["class_id", "raw_text"]).groupBy("class_id", "method_id", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("k"))
        counted = near.groupBy("class_id", "method_id").agg((F.sum("k") - 1).alias("k")).groupBy("class_id").agg((F.sum("k") / 2).cast("long").alias("q"))
        overlap = overlap.unionByName(counted)
    sizes = methods.groupBy("class_id").agg(F.count(F.lit(1)).alias("m"))
    pairs = F.col("m") * (F.col("m") - 1) / 2
    value = F.greatest(pairs - 2 * F.coalesce("q", F.lit(0)), F.lit(0.0))
    joined = classes.join(sizes, F.col("id") == F.col("class_id"), "left").drop("class_id").join(overlap, F.col("id") == F.col("class_id"), "left")
    return joined.select("id", F.coalesce(value, F.lit(0.0)).alias("cohesion"))


def outbound(edges: DataFrame, symbols: DataFrame, files: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges with their target, where they have one; no kinds: no rows."""
    to = symbols.select(F.col("id").alias("to_symbol_id"), F.col("qualified_name").alias("target_name"), F.col("file_id").alias("target_file"))
    at = files.select(F.col("id").alias("target_file"), F.col("rel_path").alias("target_path"))
    return edges.where(F.col("kind").isin(kinds)).join(to, "to_symbol_id", "left").join(at, "target_file", "left").select("id", "kind", "from_symbol_id", "to_symbol_id", "target_name", "target_path", "confidence")


def inbound(edges: DataFrame, symbols: DataFrame, files: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges with their source."""
    frm = symbols.select(F.col("id").alias("from_symbol_id"), F.col("qualified_name").alias("source_name"), F.col("file_id").alias("source_file"))
    at = files.select(F.col("id").alias("source_file"), F.col("rel_path").alias("source_path"))
    return edges.where(F.col("kind").isin(kinds) & F.col("to_symbol_id").isNotNull()).join(frm, "from_symbol_id").join(at, "source_file").select("id", "kind", "from_symbol_id", "to_symbol_id", "source_name", "source_path", "confidence")


def relationship_lines(edges: DataFrame, symbols: DataFrame, limit: int = 10) -> DataFrame:
    """(id, lines): a symbol's edges as text, sorted, without repeats, the first ten.

    Lines are made distinct by a shuffle-side aggregation and ranked; no symbol's edges are
    gathered into one array before the cut."""
    names = symbols.select(F.col("id"), F.col("qualified_name"))
    frm, to = names.select(F.col("id").alias("from_symbol_id"), F.col("qualified_name").alias("a")), names.select(F.col("id").alias("to_symbol_id"), F.col("qualified_name").alias("b"))
    named = edges.join(frm, "from_symbol_id").join(to, "to_symbol_id")
    text = lambda way: F.format_string(f"[{way} %s] %s -> %s", "kind", "a", "b")
    both = named.select(F.col("from_symbol_id").alias("id"), text("out").alias("line")).unionByName(named.select(F.col("to_symbol_id").alias("id"), text("in").alias("line"))).distinct()
    first = both.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("line"))).where(F.col("n") <= limit)
    return first.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))


def slice_from(edges: DataFrame, symbols: DataFrame, roots: DataFrame, reverse: bool = False, max_depth: int | None = None, include_tests: bool = False, max_rounds: int = 100_000) -> DataFrame:
    """(id, depth): symbols that breadth-first search reaches from roots (id); tests are neither entered nor passed.

    Each layer is one equi-join with the edges and one anti-join with what was reached, which is
    one scan of a shared folder. With no depth it ends when a layer is empty; a search that is
    not over after max_rounds layers is an error, not a part of the answer."""
    step = edges.where("from_symbol_id is not null and to_symbol_id is not null")
    step = step.select(F.col("to_symbol_id" if reverse else "from_symbol_id").alias("a"), F.col("from_symbol_id" if reverse else "to_symbol_id").alias("b")).where("a <> b").distinct()
    if not include_tests:
        tests = symbols.where("kind = 'Test'").select("id")
        step = step.join(tests.select(F.col("id").alias("b")), "b", "left_anti")
        roots = roots.join(tests, "id", "left_anti")
    step = cut(step.select("a", "b"))
    layers = Layers(roots.select("id").distinct(), "depth")
    last = layers.all()
    while max_depth is None or layers.n <= max_depth:
        if layers.n > max_rounds:
            raise RuntimeError(f"the slice goes on after {max_rounds} layers")
        last = layers.add(step.join(last.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct().join(layers.all().select("id"), "id", "left_anti"))
        if last.isEmpty():
            break
    return layers.all().select("id", "depth")


def context(edges: DataFrame, symbols: DataFrame, roots: DataFrame, mode: str, max_depth: int = 1, kinds: list[str] | None = None) -> DataFrame:
    """(id, distance, parent_id, direction): layered search by mode to max_depth; the first reach wins, by direction, parent, then id.

    Impact goes in at every depth and out at the first only."""
    used = edges.where(F.col("kind").isin(kinds or KINDS.get(mode, DEFAULT_KINDS)) & F.col("to_symbol_id").isNotNull() & (F.col("confidence") != "Unresolved"))
    used = cut(used.select("from_symbol_id", "to_symbol_id", "confidence"))
    layers = Layers(roots.select("id", F.lit(None).cast("long").alias("parent_id"), F.lit("root").alias("direction")).dropDuplicates(["id"]), "distance")
    last = layers.all()
    for depth in range(max_depth):
        ways = ("in", "out") if mode == "impact" and depth == 0 else DIRECTIONS[mode]
        here = last.select(F.col("id").alias("parent_id"))
        found = None
        for way in ways:
            near, far = ("to_symbol_id", "from_symbol_id") if way == "in" else ("from_symbol_id", "to_symbol_id")
            own = used.join(here, used[near] == here["parent_id"]).select(F.col(far).alias("id"), "parent_id", F.lit(way).alias("direction"))
            found = own if found is None else found.unionAll(own)
        best = found.groupBy("id").agg(F.min(F.struct("direction", "parent_id")).alias("x"))
        last = layers.add(best.join(layers.all().select("id"), "id", "left_anti").select("id", F.col("x.parent_id").alias("parent_id"), F.col("x.direction").alias("direction")))
        if last.isEmpty():
            break
    return layers.all().select("id", "distance", "parent_id", "direction")


def unresolved_edges(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """One row (unresolved): how many edges of these kinds a search passes over as they have no target."""
    return edges.where(F.col("kind").isin(kinds)).agg(F.count_if((F.col("confidence") == "Unresolved") | F.col("to_symbol_id").isNull()).alias("unresolved"))


def graph_context(edges: DataFrame, symbols: DataFrame, root_id: int, mode: str, max_depth: int = 2, max_nodes: int = 200, include_root: bool = True) -> dict[str, DataFrame]:
    """The graph around one symbol: nodes (id, depth, place), edges (from_id, to_id, label, confidence), diagnostics (severity, message).

    Breadth first over resolved edges of any kind, by depth and then id; a node's parent is the
    first that reaches it. After max_nodes nodes nothing more is taken or expanded, and a warning
    says so. Edges are those of expanded nodes, once per ends and label. An expanded symbol with
    an edge to one already reached, other than the edge that reached it, is reported as a loop."""
    ways = DIRECTIONS[mode]
    used = cut(edges.where("from_symbol_id is not null and to_symbol_id is not null").select("id", "from_symbol_id", "to_symbol_id", "raw_text", "confidence"))
    spark = edges.sparkSession
    root = spark.range(1).select(F.lit(root_id).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id")).join(symbols.select("id"), "id", "left_semi")
    layers = Layers(root, "depth")
    last = layers.all().select("id", "parent_id")

    def steps(from_: DataFrame) -> DataFrame:
        """An edge for each way that it is passed from a node."""
        out = None
        for way in ways:
            near, far = ("to_symbol_id", "from_symbol_id") if way == "in" else ("from_symbol_id", "to_symbol_id")
            own = used.join(from_.select(F.col("id").alias("at")), used[near] == F.col("at")).select("at", F.col(far).alias("to"), "from_symbol_id", "to_symbol_id", "raw_text", "confidence")
            out = own if out is None else out.unionAll(own)
        return out

    for _ in range(max_depth):
        found = steps(last).join(symbols.select(F.col("id").alias("to")), "to", "left_semi").groupBy(F.col("to").alias("id")).agg(F.min("at").alias("parent_id"))
        last = layers.add(found.join(layers.all().select("id"), "id", "left_anti").select("id", "parent_id"))
        if last.isEmpty():
            break
    reached = layers.all()
    listed = reached if include_root else reached.where("depth > 0")
    some = listed.orderBy("depth", "id").limit(max_nodes + 1)  # the report's size
    some = cut(some.withColumn("place", F.row_number().over(W.orderBy("depth", "id"))))
    nodes = some.where(F.col("place") <= max_nodes)
    truncated = some.where(F.col("place") > max_nodes)
    expanded = nodes.select("id", "depth")
    if not include_root:
        expanded = expanded.unionAll(reached.where("depth = 0").select("id", "depth"))
    expanded = expanded.where(F.col("depth") < max_depth)
    walked = cut(steps(expanded))
    kept = walked.groupBy(F.col("from_symbol_id").alias("from_id"), F.col("to_symbol_id").alias("to_id"), F.col("raw_text").alias("label")).agg(F.min("confidence").alias("confidence"))
    children = reached.where("depth > 0").groupBy(F.col("parent_id").alias("at")).agg(F.count(F.lit(1)).alias("children"))
    loops = walked.groupBy("at").agg(F.count(F.lit(1)).alias("n")).join(children, "at", "left").where(F.col("n") > F.coalesce("children", F.lit(0)))
    named = loops.join(symbols.select(F.col("id").alias("at"), "qualified_name"), "at")
    said = named.select(F.lit("info").alias("severity"), F.concat(F.lit("Cycle or loop detected at symbol: "), "qualified_name").alias("message")).distinct()
    warning = truncated.select(F.lit("warning").alias("severity"), F.lit(f"Context truncated: max_nodes limit ({max_nodes}) reached.").alias("message"))
    return {"nodes": nodes.select("id", "depth", "place"), "edges": kept, "diagnostics": said.unionAll(warning)}


def slice_tree(edges: DataFrame, symbols: DataFrame, root_id: int, max_depth: int = 10, max_lines: int = 100) -> DataFrame:
    """(place, depth, line): the forward slice as an indented tree, depth first, children by their first edge.

    A symbol on its own path is named once more, as already visited, and not entered. After
    max_lines lines a last one says that the tree goes on. Only paths that can be among the first
    lines are followed, so the work is bounded by the report, not by the number of paths."""
    step = edges.where("from_symbol_id is not null and to_symbol_id is not null").groupBy(F.col("from_symbol_id").alias("a"), F.col("to_symbol_id").alias("b")).agg(F.min("id").alias("edge"))
    step = cut(step.join(symbols.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b", "edge"))
    root = F.lit(root_id).cast("long")
    layer = cut(symbols.where(F.col("id") == root).select("id", F.array(root).alias("path"), F.array().cast("array<int>").alias("key"), F.lit(False).alias("again")))
    out = layer
    for _ in range(max_depth):
        layer = layer.where("not again").orderBy("key").limit(max_lines + 1)
        nth = F.row_number().over(W.partitionBy("path").orderBy("edge"))
        layer = cut(
            layer.join(step, F.col("id") == F.col("a")).withColumn("n", nth)
            .select(F.col("b").alias("id"), F.array_append("path", F.col("b")).alias("path"), F.array_append("key", F.col("n").cast("int")).alias("key"), F.array_contains("path", F.col("b")).alias("again"))
        )
        if layer.isEmpty():
            break
        out = out.unionAll(layer)
    order = W.orderBy("key")
    first = out.orderBy("key").limit(max_lines + 1).withColumn("place", F.row_number().over(order))  # the report's size
    named = first.join(symbols.select("id", "qualified_name"), "id").withColumn("depth", F.size("key"))
    indent = F.when(F.col("depth") > 0, F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("└─ "))).otherwise("")
    text = F.when(F.col("place") > max_lines, F.concat(indent, F.lit("... (truncated)"))).otherwise(F.concat(indent, "qualified_name", F.when(F.col("again"), " (already visited)").otherwise("")))
    return named.select("place", "depth", text.alias("line"))


def like_literal(column: Column, query: str) -> Column:
    """Contains, whatever the case; the query's own % and _ are no wildcards."""
    return F.contains(F.lower(column), F.lit(query.lower()))


def find_symbols(symbols: DataFrame, files: DataFrame, query: str) -> DataFrame:
    """(tier, id, ...): exact qualified name, exact name, part of the qualified name, part of the name; the first tier wins."""
    tier = F.when(F.col("qualified_name") == query, 0).when(F.col("name") == query, 1).when(like_literal(F.col("qualified_name"), query), 2).when(like_literal(F.col("name"), query), 3)
    hit = symbols.withColumn("tier", tier).where("tier is not null")
    return hit.join(files.select(F.col("id").alias("file_id"), "rel_path"), "file_id", "left").select("tier", "id", "name", "qualified_name", "kind", "rel_path")


def list_symbols(symbols: DataFrame, part: str, limit: int, kind: str | None = None) -> DataFrame:
    """The first `limit` symbols by id whose name has a part, and of these, not of all, those of a kind."""
    found = symbols.where(like_literal(F.col("name"), part)).orderBy("id").limit(limit)
    return found.where(F.col("kind") == kind) if kind else found


def tests_by_file(symbols: DataFrame) -> DataFrame:
    """(file_id, tests, others)."""
    return symbols.groupBy("file_id").agg(F.count_if(F.col("kind") == "Test").alias("tests"), F.count_if(F.col("kind") != "Test").alias("others"))


def neighbours(edges: DataFrame, symbol_id: int) -> DataFrame:
    """(id): what a symbol's resolved edges lead to and come from."""
    out = edges.where((F.col("from_symbol_id") == symbol_id) & F.col("to_symbol_id").isNotNull()).select(F.col("to_symbol_id").alias("id"))
    return out.union(edges.where(F.col("to_symbol_id") == symbol_id).select("from_symbol_id")).distinct()


def slice_paths(edges: DataFrame, root_id: int, max_depth: int) -> DataFrame:
    """(id, path, depth): every path from a symbol along resolved edges that meets no symbol twice."""
    step = edges.where("to_symbol_id is not null").select(F.col("from_symbol_id").alias("a"), F.col("to_symbol_id").alias("b")).distinct()
    root = F.lit(root_id).cast("long")
    layer = edges.sparkSession.range(1).select(root.alias("id"), F.array(root).alias("path"))
    out = layer.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        layer = layer.join(step, F.col("id") == F.col("a")).where(~F.array_contains("path", F.col("b"))).select(F.col("b").alias("id"), F.array_append("path", F.col("b")).alias("path"))
        out = out.unionAll(layer.withColumn("depth", F.lit(depth)))
    return out


def lookup(table: DataFrame, ids: DataFrame | list[int], key: str = "id") -> DataFrame:
    """Rows by key: of a few ids, or of a frame's (id)."""
    if isinstance(ids, DataFrame):
        return table.join(ids.select(F.col("id").alias(key)), key, "left_semi")
    return table.where(F.col(key).isin(list(ids)))


def resolve_symbol(found: DataFrame) -> DataFrame:
    """One row from find_symbols: status Unique, Ambiguous or NotFound by the best of three classes, and how many it has."""
    level = F.least(F.col("tier"), F.lit(2))
    best = found.agg(F.min(level).alias("best"), *[F.count_if(level == k).alias(f"n{k}") for k in range(3)], *[F.min(F.when(level == k, F.col("id"))).alias(f"id{k}") for k in range(3)])
    n = F.when(F.col("best") == 0, F.col("n0")).when(F.col("best") == 1, F.col("n1")).otherwise(F.col("n2"))
    i = F.when(F.col("best") == 0, F.col("id0")).when(F.col("best") == 1, F.col("id1")).otherwise(F.col("id2"))
    status = F.when(F.col("best").isNull(), "NotFound").when(n == 1, "Unique").otherwise("Ambiguous")
    return best.select(status.alias("status"), n.alias("matches"), F.when(status == "Unique", i).alias("id"))


def score_roots(symbols: DataFrame, files: DataFrame, query: str) -> DataFrame:
    """Symbols that a query may mean, with class and score."""
    low = query.lower()
    placed = symbols.join(files.select(F.col("id").alias("file_id"), F.col("rel_path").alias("path")), "file_id")
    qn, name, path = F.col("qualified_name"), F.col("name"), F.col("path")
    words = placed.sparkSession.range(1).select(tokenize(F.lit(query)).alias("t")).first()["t"]
    tokens = tokenize(qn)
    common = sum((F.when(F.array_contains(tokens, w), 1).otherwise(0) for w in words), F.lit(0))
    cases = [
        (qn == query, 0, 100), (name == query, 1, 90), (F.lower(qn) == low, 2, 80), (F.lower(name) == low, 2, 75), ((path == query) | (F.lower(path) == low), 3, 70),
        (F.lower(stem(file_name(path))) == low, 4, 60), (F.contains(F.lower(qn), F.lit(low)) | F.contains(F.lower(name), F.lit(low)), 5, 40), (F.contains(F.lower(path), F.lit(low)), 5, 30),
    ]
    kind, score = F.lit(6), 10 * common
    for condition, k, s in reversed(cases):
        kind, score = F.when(condition, k).otherwise(kind), F.when(condition, s).otherwise(score)
    test = F.contains(F.lower(name), F.lit("test")) | F.contains(F.lower(qn), F.lit("test")) | F.contains(F.lower(path), F.lit("test"))
    vendor = F.lower(path).rlike("vendor|node_modules|generated|target")
    scored = placed.withColumn("class", kind).withColumn("raw", score).where("raw > 0")
    final = F.col("raw") - F.when(test, 5).otherwise(0) - F.when(vendor, 10).otherwise(0)
    return scored.select("id", "name", "qualified_name", "path", "class", final.cast("int").alias("score"))


def resolve_roots(symbols: DataFrame, files: DataFrame, query: str, most: int = 5) -> DataFrame:
    """The symbols a query means: up to `most` of the exact classes (2 or less), else the single best."""
    scored = score_roots(symbols, files, query)
    order = [F.col("score").desc(), F.octet_length("qualified_name").asc(), F.col("id").asc()]
    exact = scored.where(F.col("class") <= 2).orderBy(*order).limit(most).withColumn("exact", F.lit(1))
    any_one = scored.where(F.col("class") > 2).orderBy(*order).limit(1).withColumn("exact", F.lit(0))
    both = exact.unionAll(any_one)  # at most most + 1 rows
    return both.withColumn("has", F.max("exact").over(W.partitionBy())).where("exact = has").select("id", "name", "qualified_name", "path", "class", "score")
