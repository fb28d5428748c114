"""Greedy packing of ranked snippets under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

LEAST_BUDGET = 100


def effective_budget(budget, window, reserved_answer, reserved_prompt):
    """What of a budget fits into the window beside its reserves: of numbers, or of columns."""
    if any(isinstance(x, Column) for x in (budget, window, reserved_answer, reserved_prompt)):
        b, w, a, p = (x if isinstance(x, Column) else F.lit(x) for x in (budget, window, reserved_answer, reserved_prompt))
        return F.greatest(F.least(b, w - a - p), F.lit(0))
    return max(min(budget, window - reserved_answer - reserved_prompt), 0)


def pack(candidates: DataFrame, budget: int, max_nodes: int = 200, max_files: int = 50, key: str = "query_id") -> DataFrame:
    """candidates (key, id, path, tokens, is_root, place) with status: included, or why not.

    Roots are always in and use up the budget; others go in by place while nodes, files and
    tokens last, and one that is too large is passed over, not the end. The state depends on
    every earlier choice, so each query's candidates fold in order as one array; candidates of a
    query are bounded by the search's own limits, and queries fold in parallel."""
    row = F.struct("is_root", "place", "id", "path", F.col("tokens").cast("long").alias("tokens"))
    listed = candidates.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((~F.col("is_root")).alias("later"), "place", "id", row.alias("r")))).alias("rows"))
    start = F.struct(
        F.lit(max(budget, LEAST_BUDGET)).cast("long").alias("left"), F.lit(0).alias("nodes"), F.array().cast("array<string>").alias("files"),
        F.array().cast("array<struct<id:bigint,status:string,left:bigint>>").alias("out"),
    )

    def step(state: Column, x: Column) -> Column:
        r = x["r"]
        known = F.array_contains(state["files"], r["path"])
        status = (
            F.when(r["is_root"], "included")
            .when(state["nodes"] >= max_nodes, "Truncated: max_nodes limit reached")
            .when(~known & (F.size(state["files"]) >= max_files), "Truncated: max_files limit reached")
            .when(r["tokens"] > state["left"], "Truncated: token budget exceeded")
            .otherwise("included")
        )
        taken = status == "included"
        left = F.when(taken, F.greatest(state["left"] - r["tokens"], F.lit(0).cast("long"))).otherwise(state["left"])
        return F.struct(
            left.alias("left"),
            (state["nodes"] + F.when(taken, 1).otherwise(0)).alias("nodes"),
            F.when(taken & ~known, F.array_append(state["files"], r["path"])).otherwise(state["files"]).alias("files"),
            F.array_append(state["out"], F.struct(r["id"].cast("long").alias("id"), status.alias("status"), left.alias("left"))).alias("out"),
        )

    folded = listed.select(key, F.explode(F.aggregate("rows", start, step)["out"]).alias("x"))
    return folded.select(key, F.col("x.id").alias("id"), F.col("x.status").alias("status"), F.col("x.left").alias("left"))


#: The sections of a pack, in order.
SECTIONS = ["Summary", "Root", "DirectRelationships", "KeyNeighbors", "Snippets", "OmittedSummary"]


def sections(packed: DataFrame, query: str, mode: str, budget: int, key: str = "query_id") -> DataFrame:
    """(key, place, section, text): the pack as text. packed: (key, id, qualified_name, path, snippet, tokens, is_root, place, status, line)."""
    taken = F.col("status") == "included"
    by = lambda c: F.array_sort(F.collect_list(c))
    rows = packed.groupBy(key).agg(
        by(F.when(taken & F.col("is_root"), F.struct("place", "qualified_name", "path"))).alias("roots"),
        by(F.when(taken, F.struct((~F.col("is_root")).alias("later"), "place", "qualified_name", "path", "snippet"))).alias("taken"),
        F.array_sort(F.collect_set(F.when(taken & ~F.col("is_root"), F.col("path")))).alias("files"),
        F.coalesce(F.sum(F.when(taken, F.col("tokens"))), F.lit(0)).alias("tokens"),
        F.count_if(~taken).alias("omitted"),
    )
    text = [
        F.format_string(f"Query: {query.replace('%', '%%')}\nMode: {mode}\nToken budget: {budget}\nEstimated tokens: %d\nRoots: %d", F.col("tokens"), F.size("roots")),
        F.array_join(F.transform("roots", lambda x: F.concat(x["qualified_name"], F.lit(" ("), x["path"], F.lit(")"))), "\n"),
        F.array_join(F.transform(F.slice("taken", 1, 10), lambda x: x["qualified_name"]), "\n"),
        F.concat(F.lit("Files to read\n"), F.array_join("files", "\n")),
        F.concat(F.lit("Context\n"), F.array_join(F.transform("taken", lambda x: F.concat(F.lit("  --- "), x["path"], F.lit(" "), x["qualified_name"], F.lit("\n"), F.coalesce(x["snippet"], F.lit("")))), "\n")),
        F.format_string("Omitted: %d", F.col("omitted")),
    ]
    named = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("section"), t.alias("text")) for i, (s, t) in enumerate(zip(SECTIONS, text, strict=True))])
    return rows.select(key, F.explode(named).alias("x")).select(key, "x.place", "x.section", "x.text")


def as_text(parts: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, text): a pack's sections, in order, as one text."""
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("text"))


def _documents(packed: DataFrame, fields: list[str], key: str) -> DataFrame:
    """(key, nodes): the included rows by place; a pack's nodes are bounded by its options."""
    own = packed.where("status = 'included'") if "status" in packed.columns else packed
    return own.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*fields).alias("node")))), lambda x: x["node"]).alias("nodes"))


def as_json(packed: DataFrame, fields: list[str], key: str = "query_id") -> DataFrame:
    """(key, json): one compact document per pack."""
    return _documents(packed, fields, key).select(key, F.to_json(F.struct(key, "nodes")).alias("json"))


def yaml_scalar(c: Column) -> Column:
    """A value as YAML: numbers and booleans plain, null, all else as a double-quoted string."""
    quoted = F.regexp_extract(F.to_json(F.struct(c.cast("string").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(c.isNull(), "null").otherwise(quoted)


def yaml_items(rows: Column, fields: list[str], indent: str = "") -> Column:
    """An array of structs as a YAML list."""
    line = lambda x: F.concat(*[F.concat(F.lit(f"{indent}{'- ' if i == 0 else '  '}{f}: "), yaml_scalar(x[f]), F.lit("\n")) for i, f in enumerate(fields)])
    return F.when(F.size(rows) == 0, f"{indent}[]\n").otherwise(F.array_join(F.transform(rows, line), ""))


def as_yaml(packed: DataFrame, fields: list[str], key: str = "query_id") -> DataFrame:
    """(key, yaml): one document per pack."""
    head = F.concat(F.lit(f"{key}: "), yaml_scalar(F.col(key)), F.lit("\nnodes:\n"))
    return _documents(packed, fields, key).select(key, F.concat(head, yaml_items(F.col("nodes"), fields)).alias("yaml"))


#: What the first of a recap are called.
LABELS = ["Start with", "Then read", "Then inspect"]


def recap(ranked: DataFrame, order: list[Column]) -> DataFrame:
    """(label, id): the first three by order, a top-k report."""
    best = ranked.orderBy(*order).limit(len(LABELS))
    place = F.row_number().over(W.orderBy(*order))
    return best.select(F.element_at(F.array(*[F.lit(x) for x in LABELS]), place).alias("label"), "id")
