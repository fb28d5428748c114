"""Ignore files: parsing on the driver (rules are few), matching as expressions.

`rules_of` reads every ignore file of a scan. Their number is bounded by MOST_FILES: a tree with
more is an error, as rules become one expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Rule:
    pattern: str
    base: str = ""  # directory of the ignore file
    negated: bool = False
    dir_only: bool = False
    bypass: bool = False

    def regex(self) -> str:
        """Of the relative path of what the rule names, and of everything below it."""
        body = self.pattern
        anchored = "/" in body.rstrip("/")
        body = body.strip("/")
        out, i = "", 0
        while i < len(body):
            if body.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif body.startswith("**", i):
                out, i = out + ".*", i + 2
            elif body[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif body[i] == "?":
                out, i = out + "[^/]", i + 1
            elif body[i] == "[" and "]" in body[i + 2 :]:
                j = body.index("]", i + 2)
                inside = body[i + 1 : j]
                out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", r"\\") + "]", j + 1
            elif body[i] == "\\" and i + 1 < len(body):
                out, i = out + re.escape(body[i + 1]), i + 2
            else:
                out, i = out + re.escape(body[i]), i + 1
        base = re.escape(self.base + "/") if self.base else ""
        return f"^{base}{'' if anchored else '(?:.*/)?'}{out}(?:/.*)?$"


#: The comment line after which the rest of a block holds bypass rules.
BYPASS = "#[keep]"


def parse(text: str, base: str = "", bypass_mark: str = BYPASS) -> list[Rule]:
    """Rules in order. Blocks are parted by blank lines; after a line that is bypass_mark, white space and case aside, the rest of its block holds bypass rules. Other comments say nothing."""
    mark = "".join(bypass_mark.split()).lower()
    rules, bypass = [], False
    for line in text.splitlines():
        line = line.rstrip()
        if not line:
            bypass = False
        elif line.startswith("#") and "".join(line.split()).lower() == mark:
            bypass = True
        elif not line.startswith("#"):
            negated = line.startswith("!")
            body = line[1:] if negated else line
            body = body[1:] if body.startswith("\\") and body[1:2] in "#!" else body
            rules.append(Rule(body.rstrip("/"), base, negated, body.endswith("/"), bypass))
    return rules


def ignored(path: Column, is_dir: Column, rules: list[Rule], always: list[str] = (), exclude: list[Rule] = (), everywhere: list[Rule] = ()) -> Column:
    """Whether a path is ignored: excludes of the user always hold; else the last fitting rule of
    the nearest directory decides, bypass before ignore, negation lifts; where no ignore file has
    a fitting rule, the repository's exclude file decides, and then the user's global one."""
    out = F.lit(False)
    layers = [*everywhere, *exclude, *sorted(rules, key=lambda r: (r.base.count("/") + bool(r.base), r.bypass))]
    for r in layers:
        fits = path.rlike(r.regex())
        if r.dir_only:
            exact = re.sub(r"\(\?:/\.\*\)\?\$$", "$", r.regex())
            fits = fits & (is_dir | ~path.rlike(exact))
        out = F.when(fits, F.lit(not (r.negated or r.bypass))).otherwise(out)
    for pattern in always:
        out = out | path.rlike(Rule(pattern).regex())
    return out


MOST_FILES = 1000
NAMES = (".gitignore", ".ignore")


def read_hidden(spark: SparkSession, pattern: str, most: int = MOST_FILES) -> list[tuple[str, str]]:
    """(path, text) of the files that a glob names, by the driver: Spark's readers pass over names that start with a dot."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for status in fs.globStatus(at) or []:
        if status.isFile():
            if len(out) == most:
                raise ValueError(f"more than {most} ignore files")
            stream = fs.open(status.getPath())
            try:
                out.append((status.getPath().toString(), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
    return out


def rules_of(scanned: DataFrame, root: str, names: tuple[str, ...] = NAMES, bypass_mark: str = BYPASS) -> list[Rule]:
    """The rules of all ignore files below root, down to where scanned files (rel_path) stand, outer directories first."""
    spark = scanned.sparkSession
    deepest = scanned.agg(F.max(F.size(F.split("rel_path", "/")))).first()[0] or 1
    rules: list[Rule] = []
    seen = 0
    for depth in range(deepest):
        found = read_hidden(spark, root.rstrip("/") + "/*" * depth + "/{" + ",".join(names) + "}")
        seen += len(found)
        if seen > MOST_FILES:
            raise ValueError(f"more than {MOST_FILES} ignore files")
        for path, text in sorted(found):
            base = "/".join(path.split("/")[-1 - depth : -1]) if depth else ""
            rules += parse(text, base, bypass_mark)
    return rules


def without_ignored(files: DataFrame, path: str, rules: list[Rule], always: list[str] = (), exclude: list[Rule] = (), everywhere: list[Rule] = ()) -> DataFrame:
    """files without those that are ignored, themselves or by a directory above them."""
    return files.where(~ignored(F.col(path), F.lit(False), rules, always, exclude, everywhere))
