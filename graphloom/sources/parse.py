"""Parsers: source text to symbols and occurrences, in Arrow-batched pandas over files.

No built-in expression parses a language, so this is the one place of the library's main path
that runs Python: whole files in, rows out, one file at a time in memory. In a file with a syntax
error the top-level blocks that do parse give their rows; a file of which none does, or whose
text can't be read, gives one row "failed"."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graphloom.durable import ship_package

ROW = "rel_path string, row string, kind string, name string, qualified_name string, start_line long, start_col long, end_line long, end_col long, body_start_line long, body_end_line long, nesting_depth long, complexity long, params long, raw_text string, enclosing string"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]
#: Node kinds that branch or nest.
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.BoolOp, ast.IfExp, ast.comprehension, ast.Match)
NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.Match)


@dataclass
class _Python:
    path: str
    source: str
    rows: list[tuple] = field(default_factory=list)

    def run(self) -> list[tuple]:
        self.lines = self.source.split("\n")
        stem = self.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        try:
            self.visit(ast.parse(self.source), [stem], False, None)
        except SyntaxError:
            self.rows.clear()
            if not self.recover(stem):
                raise
        return self.rows

    def recover(self, stem: str) -> bool:
        """Parse the top-level blocks one by one, each where it stands; whether any does."""
        starts = [i for i, line in enumerate(self.lines) if line[:1].strip() and not line.startswith((")", "]", "}", "#", "else", "elif", "except", "finally"))]
        starts = [s for k, s in enumerate(starts) if not (k and starts[k - 1] == s - 1 and self.lines[s - 1].startswith("@"))]
        whole, found = self.source, False
        for s, e in zip(starts, [*starts[1:], len(self.lines)], strict=True):
            self.source = "\n" * s + "\n".join(self.lines[s:e])
            try:
                self.visit(ast.parse(self.source), [stem], False, None)
                found = True
            except SyntaxError:
                continue
        self.source = whole
        return found

    def depth(self, node: ast.AST) -> int:
        inner = max((self.depth(c) for c in ast.iter_child_nodes(node)), default=0)
        return inner + isinstance(node, NESTING)

    def body_end(self, node: ast.AST) -> int:
        """The last line of the body: comments after it that stand deeper than the definition belong to it, blank lines and other comments don't."""
        end = at = node.end_lineno
        while at < len(self.lines):
            line = self.lines[at]
            text = line.lstrip()
            if text and not (text.startswith("#") and len(line) - len(text) > node.col_offset):
                break
            at += 1
            end = at if text else end
        return end

    def visit(self, node: ast.AST, scope: list[str], in_class: bool, outer: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                is_class = isinstance(child, ast.ClassDef)
                qn = "::".join([*scope, child.name])
                a = None if is_class else child.args
                params = 0 if is_class else len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
                kind = "Class" if is_class else "Method" if in_class else "Function"
                body = (None, None) if is_class else (child.body[0].lineno, self.body_end(child))
                branches = 1 + sum(isinstance(n, BRANCHES) for n in ast.walk(child))
                self.rows.append((self.path, "symbol", kind, child.name, qn, child.lineno, child.col_offset + 1, child.end_lineno, child.end_col_offset + 1, *body, self.depth(child), branches, params, None, outer))
                self.visit(child, [*scope, child.name] if is_class else scope, in_class or is_class, outer if is_class else qn)
                continue
            if isinstance(child, ast.Call):
                self.occurrence(child.func, "Call", ast.get_source_segment(self.source, child.func) or "", outer)
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                self.occurrence(child, "Import", ast.get_source_segment(self.source, child) or "", outer)
            self.visit(child, scope, in_class, outer)

    def occurrence(self, node: ast.AST, kind: str, raw: str, outer: str | None) -> None:
        self.rows.append((self.path, "occurrence", kind, None, None, node.lineno, node.col_offset + 1, node.end_lineno, node.end_col_offset + 1, None, None, None, None, None, raw, outer))


def read_python(path: str, source: str) -> list[tuple]:
    """A file of which nothing parses is an error."""
    return _Python(path, source).run()


def parse_python(path: str, source: str) -> list[tuple]:
    try:
        return read_python(path, source)
    except (SyntaxError, ValueError, RecursionError):
        return []


def failure(path: str) -> tuple:
    return (path, "failed", *[None] * (len(COLUMNS) - 2))


def _impl_name(head: str) -> str | None:
    """Of the text between impl and its brace: "Type", or "Type as Trait"."""
    angles, brackets, top = 0, 0, ""
    for i, c in enumerate(head):
        if c == ";" and not brackets:
            return None
        brackets += (c == "[") - (c == "]")
        closes = c == ">" and head[i - 1] not in "-="
        angles += (c == "<") - closes
        if not angles and not closes:
            top += c
    words = re.split(r"\bwhere\b", top)[0]
    parts = [" ".join(x.split()) for x in re.split(r"\s+for\s+", words)]
    if not parts[0]:
        return None
    return parts[0] if len(parts) == 1 else f"{parts[1]} as {parts[0]}"


_RUST = re.compile(
    r"""(?P<skip>//[^\n]*|/\*.*?\*/|b?"(?:[^"\\]|\\.)*"|r(?P<h>\#*)".*?"(?P=h)|'(?:[^'\\]|\\.)'|'[a-z_]\w*)"""
    r"""|(?P<attr>\#!?\[[^\]]*\])|(?P<item>\b(?:fn|impl|mod|struct|enum|trait)\b)|(?P<branch>\b(?:if|match|for|while|loop)\b)|(?P<call>\b[A-Za-z_][\w]*(?:(?:::|\.)[A-Za-z_]\w*)*\s*(?=\())|(?P<mark>[{};])""",
    re.S | re.X,
)


_NAME = re.compile(r"\s+([A-Za-z_]\w*)")


def parse_rust(path: str, source: str) -> list[tuple]:
    """A scanner of items, calls and braces; it knows comments, strings and attributes, not macros' insides."""
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    import bisect

    def at(offset: int) -> tuple[int, int]:
        line = bisect.bisect_right(starts, offset)
        return line, len(source[starts[line - 1] : offset].encode()) + 1

    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    rows: list[list] = []
    open_items: list[tuple[int, str, str, list | None]] = []  # depth of its brace, keyword, name, row
    depth, pending, attrs, calls = 0, None, [], []
    skip_until = 0
    for m in _RUST.finditer(source):
        if m.start() < skip_until or m["skip"] is not None:
            continue
        if m["attr"]:
            attrs.append(m["attr"])
        elif m["item"]:
            if m["item"] == "impl":
                brace = source.find("{", m.end())
                name = _impl_name(source[m.end() : brace]) if brace >= 0 else None
                if name:
                    skip_until = brace  # nothing in the head is an item or a call
            else:
                g = _NAME.match(source, m.end())
                name = g[1] if g else None
                if g:
                    skip_until = g.end()
            if name:
                pending = (m["item"], name, m.start(), list(attrs))
            attrs = []
        elif m["mark"] in ("{", ";"):
            if pending:
                word, name, start, own = pending
                impl = next((o for o in reversed(open_items) if o[1] == "impl"), None)
                mods = [o[2] for o in open_items if o[1] == "mod"]
                kinds = {"impl": "Impl", "mod": "Module", "struct": "Struct", "enum": "Enum", "trait": "Trait"}
                in_fn = next((o[3][4] for o in reversed(open_items) if o[1] == "fn"), None)
                if word == "fn":
                    kind = "Test" if any("test" in a for a in own) else "Method" if impl else "Function"
                    qn = f"{impl[2]}::{name}" if impl else "::".join([stem, *mods, name])
                else:
                    kind, qn = kinds[word], name if word == "impl" else "::".join([stem, *mods, name])
                line, col = at(start)
                params = 0
                if word == "fn":
                    inside = source[start : m.start()].partition("(")[2].rpartition(")")[0]
                    params = len([p for p in re.split(r",(?![^<(]*[>)])", inside.partition("->")[0].rstrip(" )\n")) if p.strip()]) if inside.strip() else 0
                row = [path, "symbol", kind, name, qn, line, col, line, col, None, None, 0, 1, params, None, in_fn]
                if word == "fn" and m["mark"] == "{":
                    row[9] = at(m.start())[0]
                if not (word == "fn" and m["mark"] == ";"):
                    rows.append(row)
                    if m["mark"] == "{":
                        open_items.append((depth, word, name, row))
                    else:
                        row[7], row[8] = at(m.end())
                pending = None
            if m["mark"] == "{":
                depth += 1
            attrs = []
        elif m["mark"] == "}":
            depth = max(depth - 1, 0)  # a brace too many closes nothing
            if open_items and open_items[-1][0] == depth:
                _, word, _, row = open_items.pop()
                row[7], row[8] = at(m.end())
                if row[9]:
                    row[10] = row[7]
        elif m["branch"]:
            for o in open_items:
                if o[1] == "fn":
                    o[3][12] += 1
                    o[3][11] = max(o[3][11], depth - o[0])
        elif m["call"] and not pending and open_items:
            raw = m["call"].rstrip()
            if raw not in ("if", "while", "for", "match", "return", "fn", "in", "loop", "Some", "Ok", "Err"):
                outer = next((o[3][4] for o in reversed(open_items) if o[1] == "fn"), None)
                (l1, c1), (l2, c2) = at(m.start()), at(m.start() + len(raw))
                calls.append([path, "occurrence", "Call", None, None, l1, c1, l2, c2, None, None, None, None, None, raw, outer])
    for _, _, _, row in open_items:  # a brace too few: what is open ends with the file
        row[7], row[8] = at(len(source))
        if row[9]:
            row[10] = row[7]
    return [tuple(r) for r in rows + calls]


#: Parsers by extension; a caller may add its own. One that raises an error fails its file, not the task.
PARSERS: dict[str, Callable[[str, str], list[tuple]]] = {"py": read_python, "rs": parse_rust}


def parse_files(files: DataFrame, parsers: dict[str, Callable[[str, str], list[tuple]]] | None = None) -> DataFrame:
    """files (rel_path, content) to rows of symbols and occurrences."""
    ship_package(files.sparkSession)
    chosen = dict(parsers or PARSERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, text in zip(pdf["rel_path"], pdf["content"], strict=True):
                parser = chosen.get(path.rsplit(".", 1)[-1])
                try:
                    rows = [] if not parser else [failure(path)] if text is None else parser(path, text)
                except (SyntaxError, ValueError, RecursionError):
                    rows = [failure(path)]
                if rows:
                    out = pd.DataFrame(rows, columns=COLUMNS)
                    for c in ("start_line", "start_col", "end_line", "end_col", "body_start_line", "body_end_line", "nesting_depth", "complexity", "params"):
                        out[c] = out[c].astype("Int64")
                    yield out

    return files.select("rel_path", "content").mapInPandas(run, ROW)


def tables(parsed: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and occurrences with ids made of what a row is: they are the same in any run and partitioning."""
    fid = files.select("rel_path", F.col("id").alias("file_id"))
    symbol_id = lambda qn: F.xxhash64("rel_path", qn)
    s = parsed.where("row = 'symbol'").join(fid, "rel_path")
    symbols = s.select(
        F.xxhash64("rel_path", "qualified_name", "kind", "start_line", "start_col").alias("id"), "file_id", "name", "qualified_name", "kind", "start_line", "start_col", "end_line", "end_col", "body_start_line", "body_end_line",
        "nesting_depth", (F.col("end_line") - F.col("start_line") + 1).alias("lines_of_code"), F.col("complexity").alias("complexity_proxy"), F.col("params").alias("param_count"), symbol_id(F.col("qualified_name")).alias("by_name"),
    )
    owner = symbols.where(F.col("kind").isin("Function", "Method", "Test")).groupBy("by_name").agg(F.min("id").alias("enclosing_symbol_id"))
    o = parsed.where("row = 'occurrence'").join(fid, "rel_path").withColumn("by_name", F.when(F.col("enclosing").isNotNull(), symbol_id(F.col("enclosing"))))
    occurrences = o.join(owner, "by_name", "left").select(
        F.xxhash64("rel_path", F.lit("occ"), "kind", "start_line", "start_col", "end_line", "end_col", "raw_text").alias("id"), "file_id", "enclosing_symbol_id", "kind", "raw_text", "start_line", "start_col", "end_line", "end_col",
    )
    return symbols.drop("by_name"), occurrences
