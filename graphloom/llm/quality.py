"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

A rating's grade is the number of its good marks: quality, and not toxic; grades 0, 1, 2. One
weight vector over hashed text features is shared by all grades; ordered thresholds t1 < t2 cut
the score: P(grade >= k) = logistic(score - tk). From these come the expected grade, the sum
over k of P(grade >= k), and the tail probability P(grade >= SELECT) by which rows are kept.

Features, each a place in a table of 2**BITS weights: the distinct words of the whole text,
lower-cased and stripped of what isn't a letter or digit; what was stripped from their ends;
and levels of some shares: words in capitals, words with stripped ends, words without letters,
distinct words among all, and the number of words.

Fit: on at most MAX_ROWS labelled documents, those with the smallest hash of doc_id - a bound on
the sample, so that fitting costs the same for any corpus: a doc_id that stands on many rows sends
one of its texts to the fit, as often as it has ratings. It happens on the driver with numpy,
in a fixed order (reruns agree), by AdaGrad with an L1 step that leaves few weights nonzero.
Scoring reads every document's whole text; the weights, 2**BITS floats, are a bounded broadcast.

Defined results: null and empty texts have just the level features; labels with a null, or
without a document, don't count; several labels of one document are so many ratings; without
any label scores are null and all rows are kept; repeated rows are scored each; extra columns
pass through `select`; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from graphloom.llm.common import enter, fresh, read, ship, spread, trim

BITS = 18
MAX_ROWS = 12_000
GRADES = 3
SELECT = 2
CUTOFF = 0.5
MEMO = 100_000


def _place(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) & (1 << BITS) - 1


def _split(word: str) -> tuple[str, str]:
    """The word without leading and trailing marks, and its trailing marks."""
    if word.isalnum():
        return word, ""
    i, j = 0, len(word)
    while i < j and not word[i].isalnum():
        i += 1
    while j > i and not word[j - 1].isalnum():
        j -= 1
    return word[i:j], word[j:]


def _level(name: str, share: float) -> str:
    return f"\x00{name}{round(share * 8)}"


class Features:
    """Places of a text's features; remembers those of recent words."""

    def __init__(self) -> None:
        self.memo: dict[str, tuple[int, int, int]] = {}

    def _word(self, word: str) -> tuple[int, int, int]:
        """Place of the word, place of its end or -1, and bits: in capitals, marked end, no letter or digit."""
        core, end = _split(word)
        bits = (len(core) > 1 and core.isupper()) | (len(end) > 1) << 1 | (not core) << 2
        found = (_place(core.lower()), _place("\x00end" + end) if len(end) > 1 else -1, bits)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[word] = found
        return found

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        distinct = set(words)
        get, slow = self.memo.get, self._word
        met = [get(w) or slow(w) for w in distinct]
        n = max(len(met), 1)
        bits = [m[2] for m in met]
        levels = [
            _level("capitals", sum(b & 1 for b in bits) / n),
            _level("ends", sum(b >> 1 & 1 for b in bits) / n),
            _level("marks", sum(b >> 2 for b in bits) / n),
            _level("distinct", math.log2(1 + len(distinct)) / math.log2(2 + len(words))),
            _level("words", math.log2(1 + len(words)) / 16),
        ]
        places = {m[0] for m in met}
        places.update(m[1] for m in met)
        places.discard(-1)
        places.update(map(_place, levels))
        return np.fromiter(places, np.int32, len(places))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES - 1, one column each."""
        return _logistic(score[:, None] - self.thresholds[None, :])


def fit(features: list[np.ndarray], grades: np.ndarray, epochs: int = 40, rate: float = 0.15, l1: float = 3e-4, batch: int = 128) -> Model:
    """Maximum likelihood of the cumulative-link model; deterministic. With few ratings the L1 step weighs more."""
    l1 = max(l1, 0.9 / max(len(features), 1))
    # a feature that few rated texts have says more about them than about grades
    common = np.bincount(np.concatenate(features), minlength=1 << BITS) >= min(12, max(2, len(features) // 500))
    features = [x[common[x]] for x in features]
    n = len(features)
    w, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
    share = np.array([np.clip(np.mean(grades >= k), 0.01, 0.99) for k in range(1, GRADES)])
    t = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(GRADES - 1))
    t_seen = np.full(GRADES - 1, 1e-3)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        shuffled = order.permutation(n)
        for i in range(0, n, batch):
            rows = shuffled[i : i + batch]
            sizes = np.array([len(features[r]) for r in rows])
            places = np.concatenate([features[r] for r in rows])
            owner = np.repeat(np.arange(len(rows)), sizes)
            score = np.bincount(owner, w[places], len(rows))
            y = grades[rows]
            # edges[:, k] = P(grade >= k), 1 at k = 0 and 0 at k = GRADES
            edges = np.concatenate([np.ones((len(rows), 1)), _logistic(score[:, None] - t[None, :]), np.zeros((len(rows), 1))], axis=1)
            at = np.arange(len(rows))
            low, high = edges[at, y], edges[at, y + 1]
            p = np.maximum(low - high, 1e-9)
            up = (1 - low - high) / len(rows)  # of the log likelihood by the score
            touched, inverse = np.unique(places, return_inverse=True)
            g = np.bincount(inverse, np.repeat(up, sizes))
            seen[touched] += g * g
            step = rate / np.sqrt(seen[touched])
            moved = w[touched] + step * g
            w[touched] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            tg = np.zeros(GRADES + 1)
            np.add.at(tg, y, -low * (1 - low) / p / len(rows))
            np.add.at(tg, y + 1, high * (1 - high) / p / len(rows))
            tg = tg[1:GRADES]
            t_seen += tg * tg
            t = np.maximum.accumulate(t + rate * tg / np.sqrt(t_seen))
            t[1:] = np.maximum(t[1:], t[:-1] + 1e-3)
    return Model(w.astype(np.float32), t)


def ratings(labels: DataFrame) -> DataFrame:
    """Rows (doc_id, grade): the bounded sample of ratings."""
    graded = labels.where("quality is not null and toxic is not null and doc_id is not null")
    grade = F.least(F.greatest(F.col("quality"), F.lit(0)), F.lit(1)) + F.when(F.col("toxic") > 0, 0).otherwise(1)
    return graded.select("doc_id", grade.cast("int").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(MAX_ROWS)


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model | None:
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        own = Features()
        for b in batches:
            texts = b.column("_text")
            places = [np.sort(own.of(texts[i].as_py())).tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("grade"), b.column("times"), pa.array(places, pa.binary())], ["id", "grade", "times", "places"])

    # at most MAX_ROWS narrow rows, so as many distinct (id, grade)
    sample = ratings(labels).groupBy(F.col("doc_id").alias("_label"), "grade").agg(F.count(F.lit(1)).alias("times"))
    own = spread(docs.select(F.col("doc_id").alias("_id"), F.col(text).alias("_text")))
    rated = own.join(F.broadcast(sample), F.col("_id") == F.col("_label")).select("_id", "_text", "grade", "times")
    places = rated.mapInArrow(run, T.StructType([T.StructField("id", own.schema["_id"].dataType), T.StructField("grade", T.IntegerType()), T.StructField("times", T.LongType()), T.StructField("places", T.BinaryType())]))
    got = places.groupBy("id", "grade", "times").agg(F.min("places").alias("places")).collect()  # bounded by the sample, however often an id repeats
    if not got:
        return None
    got = sorted((r for r in got for _ in range(r["times"])), key=lambda r: (r["id"], r["grade"]))
    return fit([np.frombuffer(r["places"], np.int32) for r in got], np.array([r["grade"] for r in got]))


def _scored(docs: DataFrame, model: Model | None, text: str, keep_columns: list[str]) -> tuple[DataFrame, str, str]:
    """keep_columns of docs, then the expected grade and the tail probability, whose names come with it."""
    own_text, expected, tail = (fresh(keep_columns, c) for c in ("_scored_text", "_expected", "_tail"))
    rest = docs.select(*[F.col(f"`{c}`") for c in keep_columns], F.col(text).alias(own_text))
    if model is None:
        null = F.lit(None).cast("double")
        return rest.drop(own_text).select("*", null.alias(expected), null.alias(tail)), expected, tail
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        own, m = Features(), shared.value
        for b in batches:
            texts = b.column(own_text)
            score = np.array([m.weights[own.of(texts[i].as_py())].sum(dtype=np.float64) for i in range(b.num_rows)])
            tails = m.tails(score) if b.num_rows else np.zeros((0, GRADES - 1))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep_columns], pa.array(tails.sum(axis=1)), pa.array(tails[:, SELECT - 1])], [*keep_columns, expected, tail])
        del own
        trim()

    schema = T.StructType([*[docs.schema[c] for c in keep_columns], T.StructField(expected, T.DoubleType()), T.StructField(tail, T.DoubleType())])
    return spread(rest).mapInArrow(run, schema), expected, tail


def score(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Rows (doc_id, expected_grade, tail_probability, kept)."""
    ship(docs.sparkSession)
    out, expected, tail = _scored(docs, train(docs, labels, text), text, ["doc_id"])
    return out.select("doc_id", F.round(expected, 6).alias("expected_grade"), F.round(tail, 6).alias("tail_probability"), (F.col(tail).isNull() | (F.col(tail) >= CUTOFF)).alias("kept"))


def select(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """docs, all columns, without the rows that the classifier rejects."""
    ship(docs.sparkSession)
    out, expected, tail = _scored(docs, train(docs, labels, text), text, docs.columns)
    return out.where(F.col(tail).isNull() | (F.col(tail) >= CUTOFF)).drop(expected, tail)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
