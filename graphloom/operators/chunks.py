"""Structure-aware chunks of symbols and occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloom.functions.text import chunk_tokens, large_body, line_window, lines_of

CONTEXT = 2


def build(symbols: DataFrame, parents: DataFrame, occurrences: DataFrame, files: DataFrame, context: int = CONTEXT) -> DataFrame:
    """One frame of ParentSummary, SymbolDecl, SymbolBody and Occurrence chunks.

    symbols and occurrences with ranges; parents (parent_id, child_id); files (id, content). Ids
    come from what a chunk is (kind and symbol or occurrence), so they don't depend on order."""
    text = files.select(F.col("id").alias("file_id"), lines_of(F.col("content")).alias("lines"))
    has_child = parents.select(F.col("parent_id").alias("id")).distinct().withColumn("is_parent", F.lit(True))
    above = parents.select(F.col("child_id").alias("id"), F.col("parent_id").alias("container"))
    s = symbols.join(has_child, "id", "left").join(above, "id", "left").join(text, "file_id")
    start, end, body_start, body_end = (F.col(c) for c in ("start_line", "end_line", "body_start_line", "body_end_line"))
    decl_end = F.when(body_start - 1 >= start, body_start - 1).otherwise(start)
    summary_id = lambda c: F.when(c.isNotNull(), F.xxhash64(F.lit("ParentSummary"), c))

    def make(frame: DataFrame, kind: str, owner: Column, parent: Column, body: Column, first: Column, last: Column, symbol: Column, name: Column) -> DataFrame:
        made = frame.select(
            F.xxhash64(F.lit(kind), owner).alias("id"), symbol.alias("symbol_id"), parent.alias("parent_chunk_id"), F.col("file_id"), F.lit(kind).alias("kind"),
            body.alias("text"), first.alias("start_line"), last.alias("end_line"), name.alias("qualified_name"),
        )
        return made.withColumn("text_hash", F.sha2("text", 256)).withColumn("token_count", chunk_tokens(F.col("text")))

    lines, sid, qn = F.col("lines"), F.col("id"), F.col("qualified_name")
    container = summary_id(F.col("container"))
    parts = [
        make(s.where("is_parent"), "ParentSummary", sid, container, line_window(lines, start, decl_end, context), start, decl_end, sid, qn),
        make(s, "SymbolDecl", sid, container, line_window(lines, start, decl_end, context), start, decl_end, sid, qn),
        make(s, "SymbolBody", sid, container, large_body(lines, start, end, F.coalesce(body_start, start), F.coalesce(body_end, end), context), start, end, sid, qn),
    ]
    enclosing = s.select(F.col("id").alias("enclosing_symbol_id"), F.col("qualified_name").alias("outer_name"), F.when(F.col("is_parent"), F.col("id")).alias("outer"))
    o = occurrences.join(enclosing, "enclosing_symbol_id", "left").join(text, "file_id")
    parts.append(make(o, "Occurrence", sid, summary_id(F.col("outer")), line_window(lines, start, end, context), start, end, F.col("enclosing_symbol_id"), F.coalesce(F.col("outer_name"), F.col("raw_text"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def snippet(lines: Column, start: Column, end: Column, body_start: Column, body_end: Column, is_root: bool, context: int = 0, ends: int = 15) -> Column:
    """A symbol's text for a query: its body, or head and tail of one longer than 160 (root) or 80 lines."""
    n, limit = F.size(lines), 160 if is_root else 80
    head_end = F.least(body_start + ends, n)
    tail_start = F.greatest(F.greatest(body_end - ends, body_start), head_end + 1)
    omitted = F.greatest(body_end - ends, body_start) - head_end
    marker = F.when(omitted > 0, F.concat(F.lit("// ... "), omitted.cast("string"), F.lit(" lines omitted ...\n"))).otherwise("")
    long_body = F.concat(line_window(lines, start - context, head_end), marker, line_window(lines, tail_start, F.least(body_end + context, n)))
    return F.when(body_start.isNull(), line_window(lines, start, end, context)).when(body_end - body_start + 1 <= limit, line_window(lines, body_start, body_end, context)).otherwise(long_body)


def embeddable(chunks: DataFrame) -> DataFrame:
    return chunks.where("kind <> 'Occurrence'")


def read_lines(lines: Column, start: Column, end: Column, most: int) -> Column:
    """read_file's slice: a start past the end gives the last line; at most `most` lines."""
    n = F.size(lines)
    first = F.least(F.greatest(start, F.lit(1)), n)
    last = F.least(F.greatest(F.least(F.coalesce(end, n), n), first), first + most - 1)
    return F.when(n == 0, "").otherwise(F.array_join(F.slice(lines, first.cast("int"), (last - first + 1).cast("int")), "\n"))


def children(chunks: DataFrame, limit: int = 5) -> DataFrame:
    """(parent_chunk_id, id, n): each parent's first children by line."""
    n = F.row_number().over(W.partitionBy("parent_chunk_id").orderBy("start_line", "id"))
    return chunks.where("parent_chunk_id is not null").select("parent_chunk_id", "id", n.alias("n")).where(F.col("n") <= limit)
