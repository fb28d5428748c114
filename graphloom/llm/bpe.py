"""Byte-level BPE as a lazily determinised finite-state transducer.

Compilation. A trie over the vocabulary's tokens, with a hypothesis (trie node, last whole
token, pending output), is a nondeterministic transducer: reading a byte moves the node, and
where the node is a token that may follow the last one, a second hypothesis starts at the
root. "May follow" is exact: two tokens may stand side by side if and only if merging their
joined bytes by rank gives those two tokens back; a sequence whose neighbours all may stand
side by side is the merge procedure's own result, so each prefix of the input has exactly one
hypothesis at the root. Determinisation is the subset construction with pending outputs: a
state is the tuple of live hypotheses, what all of them have pending is emitted, and at the
end of the input the root's pending tokens are. States and edges are made when first met and
thrown away together past MAX_STATES, within a piece too: the current state is carried over. No token waits longer than the vocabulary's longest
token, since a hypothesis lives no longer: that is the bounded lookahead.

A piece that is a token as a whole is that token, as in the reference tokeniser libraries.
Pieces are cut by the tokenizer's pattern; a memo of recent pieces spares reruns. It has two
generations of at most MEMO pieces and MEMO_BYTES each; a piece longer than LONG_PIECE isn't kept.

Decoding streams: token bytes pass an incremental UTF-8 state machine that hands out text up
to the last whole character and keeps at most three bytes.

Defined results: null text is empty text (0 tokens); any valid text round-trips byte for byte;
special tokens are ordinary text; ids that aren't in the vocabulary raise an error; repeated
rows are encoded each; extra columns pass through `encode`; an empty table gives no rows.
Memory per worker: the trie, MAX_STATES states and their edges, 2 * MEMO_BYTES of pieces, one Arrow
batch.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from graphloom.llm.common import enter, fresh, on_leave, read, ship, spread

MAX_STATES = 400_000
MEMO = 300_000
MEMO_BYTES = 128 << 20
LONG_PIECE = 1024


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: join the neighbours whose joined bytes rank lowest, leftmost first, until none do."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """States are numbers; edges[state << 8 | byte] leads to the next and to what is emitted."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        nodes = 1
        for token, i in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = nodes
                    nodes += 1
                node = self.child[key]
            self.token_at[node] = i
        self.longest = max(map(len, ranks), default=0)
        self._whole: dict[int, bool] = {}
        self._spines: dict[int, tuple[tuple[int, ...], tuple[int, ...]] | None] = {}
        self._reset()

    def _reset(self) -> None:
        #: edge: next state << 24 | number of the emitted tuple. Packed, as there may be many.
        self.edges: dict[int, int] = {}
        self.outputs: list[tuple[int, ...]] = [()]
        self.output_number: dict[tuple[int, ...], int] = {(): 0}
        #: a state: node, last token and number of pending tokens of each hypothesis, then those tokens
        start = array("i", (0, -1, 0)).tobytes()
        self.states: list[bytes] = [start]
        self.final = array("I", [0])
        self.number: dict[bytes, int] = {start: 0}

    def _restart(self, state: int) -> int:
        """Forget all states but this one; returns its new number."""
        packed, pending = self.states[state], self.outputs[self.final[state]]
        self._reset()
        if packed in self.number:
            return self.number[packed]
        self.number[packed] = 1
        self.states.append(packed)
        self.final.append(self._output(pending))
        return 1

    def _output(self, out: tuple[int, ...]) -> int:
        n = self.output_number.get(out)
        if n is None:
            n = self.output_number[out] = len(self.outputs)
            self.outputs.append(out)
        return n

    def reachable(self, token: int) -> bool:
        """Merging makes this token from its own bytes; others come only as whole pieces."""
        if token not in self._whole:
            self._whole[token] = merge(self.bytes[token], self.ranks) == [token]
        return self._whole[token]

    def may_follow(self, last: int, token: int) -> bool:
        return self.reachable(token) if last < 0 else self._apart(last, token)

    def _spine(self, token: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """The parts at the token's right and left edge while it is being merged, from the whole down to
        a byte: each ends when it becomes the one before it. None if some part ranks above what it becomes."""
        if token not in self._spines:
            edges: list[tuple[int, ...]] = []
            for side in (-1, 0):
                part, spine = token, [token]
                while len(self.bytes[part]) > 1:
                    halves = [self.ranks[h] for h in self._halves(self.bytes[part])]
                    if any(h >= part and len(self.bytes[h]) > 1 for h in halves):
                        self._spines[token] = None
                        return None
                    part = halves[side]
                    spine.append(part)
                edges.append(tuple(spine))
            self._spines[token] = (edges[0], edges[1])
        return self._spines[token]

    def _halves(self, data: bytes) -> tuple[bytes, bytes]:
        """The two parts that the last merge of a reachable token joins."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            i = min((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def _apart(self, last: int, token: int) -> bool:
        """Merging the joined bytes gives [last, token].

        Where merged parts always rank below what they become, merges happen in the order of
        their ranks, so the parts on both sides of the border that exist at the same time are
        known; the border falls if two of them join before either is merged otherwise (a tie
        goes to the left pair). Otherwise the definition is run.
        """
        if not self.reachable(last) or not self.reachable(token):
            return False
        left, right = self._spine(last), self._spine(token)
        if left is None or right is None:
            return merge(self.bytes[last] + self.bytes[token], self.ranks) == [last, token]
        rights, lefts, i, j = left[0], right[1], 0, 0
        while True:
            x, y = rights[i], lefts[j]
            xb, yb = self.bytes[x], self.bytes[y]
            r = self.ranks.get(xb + yb)
            if r is not None and (i == 0 or r < rights[i - 1]) and (j == 0 or r <= lefts[j - 1]):
                return False
            # the younger of the two did not exist before: go back past its birth
            x_born, y_born = (x if len(xb) > 1 else -1), (y if len(yb) > 1 else -1)
            if x_born < 0 and y_born < 0:
                break
            if x_born >= y_born:
                i += 1
            else:
                j += 1
        return True

    def _grow(self, key: int) -> int:
        """Live hypotheses stay in the order of where their unfinished token starts, the root's last."""
        byte, child, token_at, live, root = key & 255, self.child.get, self.token_at.get, [], None
        flat = memoryview(self.states[key >> 8]).cast("i").tolist()
        i, end = 0, len(flat)
        while i < end:
            j = i + 3 + flat[i + 2]
            node = child(flat[i] << 8 | byte)
            if node is not None:
                last, out = flat[i + 1], flat[i + 3 : j]
                live.append((node, last, out))
                if root is None:
                    token = token_at(node)
                    if token is not None and self.may_follow(last, token):
                        root = (0, token, [*out, token])
            i = j
        live.append(root)
        emitted = live[0][2]
        n = len(emitted)
        for _, _, out in live:
            while n and out[:n] != emitted[:n]:
                n -= 1
            if not n:
                break
        packed = array("i")
        for node, last, out in live:
            packed.extend((node, last, len(out) - n, *out[n:]))
        state = packed.tobytes()
        to = self.number.get(state)
        if to is None:
            to = self.number[state] = len(self.states)
            self.states.append(state)
            self.final.append(self._output(tuple(root[2][n:])))
        edge = self.edges[key] = to << 24 | (self._output(tuple(emitted[:n])) if n else 0)
        return edge

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        state, out, edges, outputs = 0, [], self.edges, self.outputs
        for b in piece:
            edge = edges.get(state << 8 | b)
            if edge is None:
                if len(self.states) > self.max_states or len(outputs) > 1 << 22:
                    state = self._restart(state)
                    edges, outputs = self.edges, self.outputs
                edge = self._grow(state << 8 | b)
            state = edge >> 24
            if edge & 0xFFFFFF:
                out += outputs[edge & 0xFFFFFF]
        return (*out, *outputs[self.final[state]])


class Utf8Stream:
    """Incremental UTF-8: feed bytes, get text up to the last whole character.

    The machine's state is the unfinished character: how many bytes it still needs and, for
    the leads whose second byte is restricted, the range of the next. Ill-formed input raises.
    """

    #: Lead bytes, bytes that follow, range of the first that follows.
    LEADS = [(0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]

    def __init__(self) -> None:
        self.kept, self.need, self.low, self.high = b"", 0, 0x80, 0xBF

    def _step(self, b: int) -> None:
        if self.need:
            if not self.low <= b <= self.high:
                raise ValueError(f"byte {b:#x} within a character")
            self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
        elif b >= 0x80:
            row = next((r for r in self.LEADS if r[0] <= b <= r[1]), None)
            if row is None:
                raise ValueError(f"byte {b:#x} can't start a character")
            self.need, self.low, self.high = row[2:]

    def feed(self, data: bytes) -> str:
        data = self.kept + data
        # only the last character can be unfinished: run the machine from its lead byte
        at = len(data)
        for back in range(1, min(4, len(data)) + 1):
            if data[-back] & 0xC0 != 0x80:
                at = len(data) - back
                break
        self.need, self.low, self.high = 0, 0x80, 0xBF
        for b in data[at:]:
            self._step(b)
        if not self.need:
            at = len(data)
        self.kept = data[at:]
        return data[:at].decode("utf-8")

    def end(self) -> None:
        if self.need:
            raise ValueError("the input ends within a character")


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, max_states: int = MAX_STATES, memo: int = MEMO, memo_bytes: int = MEMO_BYTES):
        self.fst = Transducer(ranks, max_states)
        # the pattern's white space is Unicode's White_Space property
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        top = max(self.fst.bytes, default=-1) + 1
        self.bytes = [self.fst.bytes.get(i) for i in range(top)]
        self.digits = [str(i) for i in range(top)]
        encode = self.fst.encode
        older: dict[str, tuple[int, ...]] = {}

        class Memo(dict):
            """Two generations: a full one becomes the older, from which pieces still in use come back."""

            held = 0

            def __missing__(self, piece: str) -> tuple[int, ...]:
                nonlocal older
                ids = older.get(piece)
                if ids is None:
                    ids = encode(piece.encode())
                if len(piece) > LONG_PIECE:
                    return ids
                if len(self) >= memo or self.held >= memo_bytes:
                    older = dict(self)
                    self.clear()
                    self.held = 0
                self[piece] = ids
                self.held += 4 * len(piece) + 36 * len(ids) + 200  # at most: text, ids, their tuple, the entry
                return ids

        self.memo = Memo()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.pieces(text))))

    def decode(self, ids: Iterable[int]) -> str:
        stream = Utf8Stream()
        out = stream.feed(b"".join(map(self.bytes.__getitem__, ids)))
        stream.end()
        return out

    def decode_stream(self, ids: list[int], chunk: int = 65_536) -> Iterator[str]:
        stream, table = Utf8Stream(), self.bytes.__getitem__
        for i in range(0, len(ids), chunk):
            yield stream.feed(b"".join(map(table, ids[i : i + chunk])))
        stream.end()


_codecs: dict[tuple[str, str], Codec] = {}
on_leave.append(_codecs.clear)


def codec(file: str, pattern: str) -> Codec:
    """One codec per worker process; file is a name that Spark's file server knows."""
    enter("bpe")
    key = (file, pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(load_ranks(SparkFiles.get(file)), pattern)
    return _codecs[key]


def _share(spark: SparkSession, vocabulary: str) -> str:
    ship(spark)
    spark.sparkContext.addFile(vocabulary)
    return Path(vocabulary).name


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with token_ids array<int> in place of text, and of any column of that name."""
    docs = docs.drop("token_ids")
    file = _share(docs.sparkSession, vocabulary)
    rest = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file, pattern)
        for b in batches:
            rows = [np.array(own.encode(t or ""), np.int32) for t in b.column(text).to_pylist()]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], ids], [*rest, "token_ids"])

    return spread(docs.select(*[F.col(f"`{c}`") for c in rest], text)).mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """tokens with text in place of the ids."""
    file = _share(tokens.sparkSession, vocabulary)
    rest = [c for c in tokens.columns if c != ids]
    schema = T.StructType([*[tokens.schema[c] for c in rest], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file, pattern)
        for b in batches:
            out = ["".join(own.decode_stream(x or [])) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(out, pa.string())], [*rest, "text"])

    return tokens.select(*[F.col(f"`{c}`") for c in rest], ids).mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids_too: bool = False) -> DataFrame:
    """Every text encoded and its ids decoded: columns keep, n_tokens, ids_sha256, decoded_sha256, and token_ids if ids_too."""
    file = _share(docs.sparkSession, vocabulary)
    own_text = fresh(list(keep), "_own_text")
    more = [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] if ids_too else []
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file, pattern)
        for b in batches:
            texts = b.column(own_text)
            for start in range(0, b.num_rows, 256):  # bounds what is held encoded
                n, coded, decoded, rows = [], [], [], []
                for i in range(start, min(start + 256, b.num_rows)):
                    ids = own.encode(texts[i].as_py() or "")
                    n.append(len(ids))
                    coded.append(sha256(",".join(map(own.digits.__getitem__, ids)).encode()).hexdigest())
                    back = sha256()
                    for part in own.decode_stream(ids):
                        back.update(part.encode())
                    decoded.append(back.hexdigest())
                    if ids_too:
                        rows.append(np.array(ids, np.int32))
                columns = [*[b.column(c).slice(start, len(n)) for c in keep], pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
                if ids_too:
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows))))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return spread(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias(own_text))).mapInArrow(run, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return round_trip(read(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
