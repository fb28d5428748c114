"""Model hooks: tokenising, embedding and pair scoring, with deterministic stand-ins where no model is given."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.durable import ship_package

MAX_TOKENS = 512
DIMENSION = 768
BATCH = 16

#: Texts to one row of floats each; loaded once per task by the factory.
Embedder = Callable[[list[str]], np.ndarray]


def whitespace_ids(text: Column, most: int = MAX_TOKENS) -> Column:
    """Token ids without a tokenizer: the places of the words, from 1."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    return F.when(n > 0, F.sequence(F.lit(1), F.least(n, F.lit(most)))).otherwise(F.array().cast("array<int>"))


def batch_number(place: Column, size: int = BATCH) -> Column:
    """Which batch the row at a place (from 1) belongs to."""
    return F.floor((place - 1) / size).cast("int")


def hash_embedder(dimension: int = DIMENSION) -> Embedder:
    """Words hashed with signs into a vector: deterministic, no model file."""
    import zlib

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for i, t in enumerate(texts):
            for w in t.lower().split()[:MAX_TOKENS]:
                h = zlib.crc32(w.encode())
                out[i, h % dimension] += 1.0 if h >> 31 else -1.0
        return out

    return run


def embed(texts: DataFrame, key: str, text: str, factory: Callable[[], Embedder] = hash_embedder, batch: int = BATCH, dimension: int | None = None) -> DataFrame:
    """(key, vector): unit vectors; a text without words gives zeros, rows of another length than `dimension` are an error. The factory runs once per task, so a model loads once."""
    ship_package(texts.sparkSession)
    kind = dict(texts.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                v = np.asarray(model(part[text].fillna("").tolist()), np.float64)
                if v.ndim != 2 or v.shape[0] != len(part) or dimension is not None and v.shape[1] != dimension:
                    raise ValueError(f"the model gave {v.shape} for {len(part)} texts, not rows of {dimension}")
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0).astype(np.float32)
                yield pd.DataFrame({key: part[key].to_numpy(), "vector": list(v)})

    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<float>")


def overlap_scorer(query: str, document: Column) -> Column:
    """A pair score without a model: the share of the query's words that the document has."""
    words = F.split(F.lower(F.lit(query)), r"\W+")
    own = F.split(F.lower(document), r"\W+")
    return F.size(F.array_intersect(words, own)) / F.greatest(F.size(F.array_distinct(words)), F.lit(1))


def token_ids(text: Column, tokenizer_file: str | None = None, most: int = MAX_TOKENS) -> Column:
    """Token ids, at most `most`, by a tokenizer file that all executors can read; without one, whitespace_ids."""
    if tokenizer_file is None:
        return whitespace_ids(text, most)

    @F.pandas_udf("array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(tokenizer_file)
        own.enable_truncation(most)
        for s in parts:
            yield pd.Series([e.ids for e in own.encode_batch(s.fillna("").tolist())])

    return encode(text)


def _padded(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    width = max(1, max(map(len, rows), default=1))
    ids, mask = np.zeros((len(rows), width), np.int64), np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        ids[i, : len(r)], mask[i, : len(r)] = r, 1
    return ids, mask


def _fed(session, ids: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
    return {i.name: given[i.name] for i in session.get_inputs() if i.name in given}


def onnx_embedder(model_file: str, tokenizer_file: str, dimension: int = DIMENSION) -> Callable[[], Embedder]:
    """A factory of embedders: texts cut at MAX_TOKENS, padded, run; the first `dimension` numbers of each row's output."""

    def factory() -> Embedder:
        import onnxruntime
        from tokenizers import Tokenizer

        session, own = onnxruntime.InferenceSession(model_file), Tokenizer.from_file(tokenizer_file)
        own.enable_truncation(MAX_TOKENS)

        def run(texts: list[str]) -> np.ndarray:
            ids, mask = _padded([e.ids for e in own.encode_batch(texts)])
            out = np.asarray(session.run(None, _fed(session, ids, mask))[0]).reshape(len(texts), -1)
            if out.shape[1] < dimension:
                raise ValueError(f"the model's rows have {out.shape[1]} numbers, fewer than {dimension}")
            return out[:, :dimension]

        return run

    return factory


#: A query and texts to one score each; loaded once per task by the factory.
PairScorer = Callable[[str, list[str]], np.ndarray]


def onnx_pair_scorer(model_file: str, tokenizer_file: str) -> Callable[[], PairScorer]:
    """A factory of pair scorers: query and text encoded as a pair, the output's first number."""

    def factory() -> PairScorer:
        import onnxruntime
        from tokenizers import Tokenizer

        session, own = onnxruntime.InferenceSession(model_file), Tokenizer.from_file(tokenizer_file)
        own.enable_truncation(MAX_TOKENS)

        def run(query: str, texts: list[str]) -> np.ndarray:
            ids, mask = _padded([e.ids for e in own.encode_batch([(query, t) for t in texts])])
            return np.asarray(session.run(None, _fed(session, ids, mask))[0]).reshape(len(texts), -1)[:, 0]

        return run

    return factory


def score_pairs(hits: DataFrame, key: str, text: str, query: str, factory: Callable[[], PairScorer], batch: int = BATCH) -> DataFrame:
    """(key, pair_score) of each hit's text with the query."""
    ship_package(hits.sparkSession)
    kind = dict(hits.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                scores = np.asarray(model(query, part[text].fillna("").tolist()), np.float64)
                if scores.shape != (len(part),):
                    raise ValueError(f"the model gave {scores.shape} for {len(part)} pairs")
                yield pd.DataFrame({key: part[key].to_numpy(), "pair_score": scores})

    return hits.select(key, text).mapInPandas(run, f"{key} {kind}, pair_score double")


#: A call's place (path, line, column) to its definition's place (path, line), or None; an outside process may stand behind it.
Resolver = Callable[[str, int, int], "tuple[str, int] | None"]


def resolve_places(occurrences: DataFrame, files: DataFrame, factory: Callable[[], Resolver]) -> DataFrame:
    """Locations (occurrence_id, file_id, line) that a resolver gives for calls; match_definitions takes them. The factory runs once per task, and a call that it can't resolve gives no row."""
    placed = occurrences.where("kind = 'Call'").join(files.select(F.col("id").alias("file_id"), "rel_path"), "file_id").select(F.col("id").alias("occurrence_id"), "rel_path", "start_line", "start_col")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = factory()
        for pdf in frames:
            rows = [(i, *found) for i, path, line, col in pdf.itertuples(index=False) if (found := ask(path, int(line), int(col))) is not None]
            yield pd.DataFrame(rows, columns=["occurrence_id", "rel_path", "line"])

    answers = placed.mapInPandas(run, "occurrence_id long, rel_path string, line long")
    return answers.join(files.select("rel_path", F.col("id").alias("file_id")), "rel_path").select("occurrence_id", "file_id", "line")
