"""File visibility: one CASE chain gives the reason why an entry is hidden, null if it is visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.text import ancestors, extension, file_name

# Names and extensions of the rules, in the order in which rules are tried.
VCS_DIRS = [".git", ".jj", ".hg", ".svn"]
DEPENDENCY_DIRS = ["node_modules", ".venv", "venv"]
BUILD_DIRS = ["target", "dist", "build", ".next"]
CACHE_DIRS = [".cache", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox"]
LOCKFILES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "Cargo.lock"]
TEMPORARY_FILES = [".DS_Store"]
TEMPORARY_EXTENSIONS = ["log", "tmp", "temp", "swp", "bak"]
CODE_NAMES = "readme.md readme.txt readme license license.md license.txt contributing.md changelog.md architecture.md security.md makefile cmakelists.txt dockerfile docker-compose.yml docker-compose.yaml package.json cargo.toml tsconfig.json jsconfig.json .gitignore .gitattributes .env .env.example .env.local .dockerignore".split()
CODE_EXTENSIONS = (
    "rs go py js mjs cjs ts mts cts jsx tsx c cpp cc cxx h hpp hh cs java kt kts scala rb php swift sh bash zsh fish bat cmd ps1 html htm css scss sass less pl pm hs lua r dart zig ex exs erl clj fs asm s ml mli"
    " toml yaml yml json json5 jsonc ini conf config xml properties sql graphql gql proto mk cmake"
).split()
DOCS_NAMES = "readme license changelog contributing readme.md readme.txt license.md license.txt contributing.md changelog.md architecture.md security.md".split()
DOCS_EXTENSIONS = "md txt rst adoc asciidoc org tex pdf epub docx doc odt html htm rtf xml json csv tsv".split()
BINARY_EXTENSIONS = "png jpg jpeg gif bmp ico tiff webp zip tar gz bz2 xz rar 7z exe dll so dylib bin elf msi deb rpm class pyc pyo o obj pdb wasm mp3 wav mp4 avi mkv mov flac".split()
SKIPPED_DIRS = "target .git .graphloom .venv venv .env node_modules __pycache__ build dist".split()


def rule_reason(name: Column, is_dir: Column) -> Column:
    """The first rule that hides an entry."""
    ext = extension(name)
    return (
        F.when(is_dir & name.isin(VCS_DIRS), "VCS internals")
        .when(is_dir & name.isin(DEPENDENCY_DIRS), "dependencies")
        .when(is_dir & name.isin(BUILD_DIRS), "build artifacts")
        .when(is_dir & name.isin(CACHE_DIRS), "cache")
        .when(~is_dir & name.isin(LOCKFILES), "lockfile")
        .when(~is_dir & name.isin(TEMPORARY_FILES), "temporary file")
        .when(~is_dir & ext.isin(TEMPORARY_EXTENSIONS), "temporary file")
    )


def mode_reason(name: Column, is_dir: Column, mode: str) -> Column:
    low, ext = F.lower(name), F.coalesce(F.lower(extension(name)), F.lit(""))
    if mode == "code":
        return F.when(~is_dir & ~(low.isin(CODE_NAMES) | ext.isin(CODE_EXTENSIONS)), "non-code file")
    if mode == "docs":
        return F.when(~is_dir & ~(low.isin(DOCS_NAMES) | ext.isin(DOCS_EXTENSIONS)), "non-document file")
    if mode == "llm":
        return F.when(~is_dir & ext.isin(BINARY_EXTENSIONS), "binary file")
    return F.lit(None).cast("string")


def hidden_reason(name: Column, is_dir: Column, mode: str = "smart") -> Column:
    """Null: visible. Mode all shows everything; others try the rules, then the mode's own list."""
    if mode == "all":
        return F.lit(None).cast("string")
    return F.coalesce(rule_reason(name, is_dir), mode_reason(name, is_dir, mode))


def entries(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with their sizes, and every directory above them: (path, name, is_dir, depth, bytes)."""
    own = files.select(F.col(path).alias("path"), F.lit(False).alias("is_dir"), F.col("bytes"))
    dirs = files.select(F.explode(ancestors(F.col(path))).alias("path")).distinct().select("path", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("bytes"))
    return own.unionByName(dirs).withColumn("name", file_name(F.col("path"))).withColumn("depth", F.size(F.split("path", "/")))


def prune(listed: DataFrame) -> DataFrame:
    """Entries that stand in no hidden directory: an anti-join on exploded ancestors.

    Hidden directories are few but unbounded, so the join's strategy is Spark's to choose."""
    hidden = listed.where(F.col("is_dir") & F.col("reason").isNotNull()).select(F.col("path").alias("hidden_dir"))
    above = listed.select("path", F.explode(ancestors(F.col("path"))).alias("hidden_dir")).join(hidden, "hidden_dir", "left_semi").select("path").distinct()
    return listed.join(above, "path", "left_anti")


def scan(files: DataFrame, mode: str = "smart", max_depth: int | None = None) -> DataFrame:
    """All entries that aren't inside a hidden directory, with the reason if they are hidden themselves."""
    listed = entries(files)
    if max_depth is not None:
        listed = listed.where(F.col("depth") - 1 <= max_depth)
    return prune(listed.withColumn("reason", hidden_reason(F.col("name"), F.col("is_dir"), mode)))


def indexable(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Source files with a parser, outside skipped directories; judged on the relative path."""
    skipped = F.array(*[F.lit(x) for x in SKIPPED_DIRS])
    return files.where(~F.arrays_overlap(F.split(F.col(path), "/"), skipped) & extension(file_name(F.col(path))).isin("rs", "py"))


def safe_path(path: Column) -> Column:
    """Whether a relative path stays below its root."""
    return ~F.array_contains(F.split(path, "/"), "..") & ~F.startswith(path, F.lit("/"))


#: Fixed value: texts beyond this size are searched by name only.
SEARCHED_BYTES = 524_288


def matching_files(files: DataFrame, name: Column, text: Column, in_name: str, in_text: str | None = None) -> DataFrame:
    """files whose name or, if it isn't too large, text contains what is looked for, whatever the case."""
    small = F.octet_length(text) <= SEARCHED_BYTES
    return files.where(F.contains(F.lower(name), F.lit(in_name.lower())) | (small & F.contains(F.lower(text), F.lit((in_text or in_name).lower()))))
