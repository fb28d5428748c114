"""URL filter: sorted digest array, memory-mapped and probed with a vectorised binary search.

A rule is (verdict, host, path), written "host/path": it fits its host and all subdomains of
it where the url's path starts with the rule's path. The longest fitting rule decides, of equally
long ones that with the longer host; where none fits, the verdict is `default`. Two fitting rules
of one host and one length are one rule, so this leaves no ties.

`compile_rules` sorts the 64-bit XXH64 digests of all rule strings into one array and keeps
the strings themselves behind it, so that a probe's hit is confirmed against the full string
and a digest collision can't give a verdict. A second, smaller array of digests of the rules'
hosts, each with the lengths of the paths listed under it, keeps the number of probes to
(labels of the host) + (path lengths of the hosts that do occur). Executors get the file from
Spark's file server (lost ones get it anew) and memory-map it: processes on a machine share
its pages.

Size: the file grows with the rules, not with the urls. Up to MAX_INDEX_BYTES it is mapped;
beyond that `judge` joins the candidates of each url with the rules instead, by the same order,
which gives the same rows at any number of rules. The file is named by its content: judging again
by the same rules ships nothing anew.

Defined results: a null url, or one without "://", has an empty host and path, no rule, and
the default verdict. Repeated rows are judged each for itself. Equal rules with
different verdicts: block wins. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import atexit
import shutil
import struct
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm.common import ascii_lower, read, ship

MAX_INDEX_BYTES = 512 << 20
SEED = 0
#: The rules of the registered query: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _merged(rules: Iterable[tuple[str, str, str]]) -> dict[tuple[str, str], tuple[str, str, str]]:
    out: dict[tuple[str, str], tuple[str, str, str]] = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        key = (host, path)
        if key not in out or verdict == "block":
            out[key] = (verdict, host, path)
    return out


def _digests(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64, len(keys))


def _array(pairs: list[tuple[bytes, bytes]]) -> bytes:
    """Sorted digests, offsets of the payloads, then payloads: length of the key, key, value."""
    d = _digests([k for k, _ in pairs])
    order = np.argsort(d, kind="stable")
    blobs = [struct.pack("<I", len(pairs[i][0])) + pairs[i][0] + pairs[i][1] for i in order]
    offsets = np.zeros(len(pairs) + 1, np.uint64)
    np.cumsum([len(b) for b in blobs], out=offsets[1:])
    return struct.pack("<Q", len(pairs)) + d[order].tobytes() + offsets.tobytes() + b"".join(blobs)


def compile_rules(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The index file: digest array of the hosts with their path lengths, then that of the rules."""
    merged = _merged(rules)
    lengths: dict[str, set[int]] = {}
    for _, host, path in merged.values():
        lengths.setdefault(host, set()).add(len(path))
    hosts = _array([(h.encode(), np.array(sorted(n), np.uint32).tobytes()) for h, n in sorted(lengths.items())])
    full = _array([(f"{len(h.encode())}:{h}{p}".encode(), v.encode()) for (h, p), (v, _, _) in sorted(merged.items())])
    hosts += b"\0" * (-len(hosts) % 8)  # so that the second array is aligned where it is mapped
    return struct.pack("<Q", len(hosts)) + hosts + full


class DigestArray:
    """A memory-mapped sorted array of digests with the strings they stand for."""

    def __init__(self, data: np.ndarray):
        n = int(data[:8].view(np.uint64)[0]) if len(data) else 0
        self.digests = np.frombuffer(data[8 : 8 + 8 * n], np.uint64)
        self.offsets = np.frombuffer(data[8 + 8 * n : 16 + 16 * n], np.uint64)
        self.blobs = data[16 + 16 * n :]

    def probe(self, keys: list[bytes]) -> list[tuple[int, bytes]]:
        """(position in keys, value) of the keys that are present, each confirmed by its full string."""
        if not keys or not len(self.digests):
            return []
        want = _digests(keys)
        at = np.searchsorted(self.digests, want)
        near = at < len(self.digests)
        near[near] = self.digests[at[near]] == want[near]
        found = []
        for i in np.nonzero(near)[0]:
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == want[i]:
                blob = self.blobs[int(self.offsets[j]) : int(self.offsets[j + 1])].tobytes()
                n = struct.unpack_from("<I", blob)[0]
                if blob[4 : 4 + n] == keys[i]:
                    found.append((int(i), blob[4 + n :]))
                    break
                j += 1
        return found


class RuleIndex:
    def __init__(self, data: np.ndarray):
        n = int(data[:8].view(np.uint64)[0])
        self.hosts, self.rules = DigestArray(data[8 : 8 + n]), DigestArray(data[8 + n :])

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        owner: list[int] = []
        suffix: list[str] = []
        for i, host in enumerate(hosts):
            while host:
                owner.append(i)
                suffix.append(host)
                host = host.partition(".")[2]
        probes: list[tuple[int, str, int]] = []
        keys: list[bytes] = []
        for k, value in self.hosts.probe([s.encode() for s in suffix]):
            i, host = owner[k], suffix[k]
            for n in np.frombuffer(value, np.uint32):
                if len(paths[i]) >= n:
                    rule = host + paths[i][: int(n)]
                    probes.append((i, rule, len(host)))
                    keys.append(f"{len(host.encode())}:{rule}".encode())
        rule: list[str | None] = [None] * len(hosts)
        verdict: list[str | None] = [None] * len(hosts)
        best = [(-1, -1)] * len(hosts)
        for k, value in self.rules.probe(keys):
            i, text, of_host = probes[k]
            if (len(text), of_host) > best[i]:
                best[i], rule[i], verdict[i] = (len(text), of_host), text, value.decode()
        return rule, verdict


_open: dict[str, RuleIndex] = {}


def _index(name: str) -> RuleIndex:
    if name not in _open:
        _open.clear()
        _open[name] = RuleIndex(np.memmap(SparkFiles.get(name), np.uint8, "r"))
    return _open[name]


def url_parts(url) -> tuple:
    """Host and path as columns: JVM side, no Python."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict), one for each row of pages (page_id, url)."""
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    data = compile_rules(rules)
    if len(data) > max_index_bytes:
        return judge_by_join(parts, spark.createDataFrame(list(_merged(rules).values()), "verdict string, host string, path string"), default)
    ship(spark)
    name = ship_file(spark, data)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name)
        for b in batches:
            rule, verdict = index.judge(b.column("host").to_pylist(), b.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array([v or default for v in verdict], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    kind = dict(parts.dtypes)["page_id"]
    return parts.mapInArrow(probe, f"page_id {kind}, host string, path string, rule string, verdict string")


def ship_file(spark: SparkSession, data: bytes) -> str:
    """Hand a file to all executors, those that start later too; returns the name to ask SparkFiles for. The driver's copy, which Spark's file server reads, goes at its exit."""
    name = f"rules-{xxhash.xxh3_128_hexdigest(data)}.idx"
    shipped = spark.sparkContext.__dict__.setdefault("_graphloom_files", set())
    if name not in shipped:
        folder = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = Path(folder) / name
        at.write_bytes(data)
        spark.sparkContext.addFile(str(at))
        shipped.add(name)
    return name


def judge_by_join(parts: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same rows by an equi-join on the host's suffixes, for more rules than a file should hold.

    Urls are first reduced to their distinct (host, path): a host that is most of the input, with
    repeated urls, reaches the join once for each distinct path.
    """
    distinct = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    probes = distinct.where("host <> ''").select("host", "path", F.explode(suffixes).alias("rule_host"))
    known = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    fit = probes.join(known, "rule_host").where(F.expr("startswith(path, rule_path)"))
    text = F.concat("rule_host", "rule_path")
    best = fit.groupBy("host", "path").agg(F.max(F.struct(F.char_length(text).alias("n"), F.char_length("rule_host").alias("of_host"), text.alias("rule"), F.col("rule_verdict"))).alias("x"))
    out = parts.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("x.rule").alias("rule"), F.coalesce("x.rule_verdict", F.lit(default)).alias("verdict"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), RULES)


OP8_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(verdict, rhost, rpath) AS (
  VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')
), b AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM h JOIN r ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN b ON h.page_id = b.page_id
"""
