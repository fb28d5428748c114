"""Scalar text functions as Column expressions; none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Characters that stand for themselves in a regular expression only when escaped.
_SPECIAL = r"([\\.^$|?*+()\[\]{}])"


def estimate_tokens(text: Column) -> Column:
    """Tokens of a text for budgets: a quarter of its characters, rounded up."""
    return F.ceil(F.char_length(text) / F.lit(4.0)).cast("long")


def chunk_tokens(text: Column) -> Column:
    """Tokens of a stored chunk: a quarter of its characters, rounded down."""
    return F.floor(F.char_length(text) / F.lit(4.0)).cast("long")


def count_lines(text: Column) -> Column:
    """Lines; one final newline adds none."""
    body = F.regexp_replace(text, r"\n\z", "")
    return F.when(text == "", 0).otherwise(F.size(F.split(body, "\n"))).cast("long")


def lines_of(text: Column) -> Column:
    """The lines without their ends, as count_lines counts them."""
    body = F.regexp_replace(text, r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"\r\z", "")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """After the last dot, if something stands before it; null without one."""
    found = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), found)


def stem(name: Column) -> Column:
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def parent_dir(path: Column) -> Column:
    """Up to the last slash; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """Every directory above a path but the root, outermost first."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def tokenize(text: Column) -> Column:
    """Lower-cased words of an identifier or path: cut at : . - _ / \\ and white space and where
    capitals start a word; the whole text comes last if it isn't one of them."""
    humps = F.regexp_replace(text, r"(?<=\p{Ll})(?=\p{Lu})|(?<=[^:.\-_/\\\s])(?=\p{Lu}\p{Ll})", " ")
    words = F.transform(F.filter(F.split(humps, r"[:.\-_/\\\s]+"), lambda x: x != ""), lambda x: F.lower(x))
    whole = F.lower(text)
    return F.when(F.array_contains(words, whole), words).otherwise(F.concat(words, F.array(whole)))


def is_subsequence(sub: Column, full: Column) -> Column:
    """Whether the characters of sub occur in full in their order."""
    escaped = F.regexp_replace(sub, _SPECIAL, r"\\$1")
    pattern = F.array_join(F.regexp_extract_all(escaped, F.lit(r"(?s)(\\.|.)"), 1), ".*")
    return F.regexp_like(full, F.concat(F.lit("(?s)"), pattern))


def callee_name(raw: Column) -> Column:
    """The last part of a call's text: after the last ::, else after the last dot."""
    return F.when(F.contains(raw, F.lit("::")), F.substring_index(raw, "::", -1)).when(F.contains(raw, F.lit(".")), F.substring_index(raw, ".", -1)).otherwise(raw)


def is_method_call(raw: Column) -> Column:
    return F.contains(raw, F.lit(".")) & ~F.contains(raw, F.lit("::"))


def is_test_like(name: Column, qualified: Column, path: Column) -> Column:
    return F.contains(F.lower(name), F.lit("test")) | F.contains(F.lower(qualified), F.lit("test")) | F.contains(F.lower(path), F.lit("test"))


def is_vendor_like(path: Column) -> Column:
    return path.rlike("vendor|node_modules|generated|target")


def xml_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def fence(text: Column) -> Column:
    """A Markdown fence longer than any run of backticks in the text, three at least."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), lambda x: F.char_length(x))), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))


def attribute(line: Column, name: str) -> Column:
    return F.regexp_extract(line, rf'\b{name}="([^"]*)"', 1)


def clean_type_name(name: Column) -> Column:
    """Without generics."""
    return F.trim(F.substring_index(name, "<", 1))


def human_bytes(n: Column) -> Column:
    """With one decimal, halves to even."""
    scaled = lambda power, unit: F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(1024**power)), 1))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, scaled(1, "KB")).when(n < 1024**3, scaled(2, "MB")).otherwise(scaled(3, "GB"))


def rust_tests(text: Column) -> Column:
    """Test functions of a Rust file: attribute lines of the usual frameworks."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*#\s*\[\s*(test|tokio::test|async_std::test|rstest|test_case|actix_rt::test)([\]\(\s]|$)"))).cast("long")


def python_tests(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*(async\s+)?def test_"))).cast("long")


def line_window(lines: Column, start: Column, end: Column, context: int = 0) -> Column:
    """Lines start - context .. end + context, clamped to the file, each with its newline; empty if there are none."""
    first = F.greatest(start - context, F.lit(1))
    last = F.least(end + context, F.size(lines))
    inside = (F.size(lines) > 0) & (first <= F.size(lines)) & (first <= last)
    return F.when(inside, F.concat(F.array_join(F.slice(lines, first.cast("int"), (last - first + 1).cast("int")), "\n"), F.lit("\n"))).otherwise("")


def large_body(lines: Column, start: Column, end: Column, body_start: Column, body_end: Column, context: int = 0, limit: int = 80, ends: int = 15) -> Column:
    """The window over a symbol; a body of more than `limit` lines keeps its first and last `ends` around a marker."""
    n = F.size(lines)
    head_end = F.least(body_start + ends, n)
    tail_start = F.greatest(body_end - ends, body_start)
    omitted = tail_start - head_end
    head = line_window(lines, start - context, head_end)
    marker = F.when(omitted > 0, F.concat(F.lit("// ... "), omitted.cast("string"), F.lit(" lines omitted ...\n"))).otherwise("")
    tail = line_window(lines, F.greatest(tail_start, head_end + 1), F.least(end + context, n))
    return F.when(body_end - body_start + 1 <= limit, line_window(lines, start, end, context)).otherwise(F.concat(head, marker, tail))


def signature(lines: Column, start: Column) -> Column:
    """At most three lines from a symbol's first, up to the body's brace or the closing mark."""
    joined = F.array_join(F.transform(F.slice(lines, start.cast("int"), 3), lambda x: F.trim(x)), " ")
    return F.trim(F.regexp_extract(joined, r"^([^{;]*)", 1))


def percent_decode(text: Column) -> Column:
    """%XX as UTF-8; a plus sign is itself."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
