"""Byte-level BPE encoding and decoding on padded numpy matrices.

Each text is split by the tokenizer's pattern. The pieces that a task has not met yet become rows of byte-id matrices, bucketed by
length, and all rows of a matrix merge together: in a round every row merges its leftmost pair of minimum rank, found in an open
hash table of pairs, the row closes up, and finished rows leave the matrix. A task keeps the ids of the pieces it has seen, so a
frequent word is merged once a task. Decoding gathers token bytes by offsets. Both work on slices of bounded size.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import giving_back, ship

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text that a slice holds, unless one text alone has more.
SLICE = 1_500_000
#: Pieces that a task remembers before it starts afresh, and the longest that it remembers.
KNOWN_PIECES, KNOWN_LENGTH = 150_000, 64
#: Pieces of more bytes are merged one by one with a heap, as rounds over a matrix take time quadratic in their length: at 512 bytes both
#: take 1.8 ms a piece, at 8192 bytes 242 ms against 30 ms.
MATRIX_WIDTH = 512
NEVER = np.iinfo(np.int32).max

#: The letters, numbers and white space up to U+017F.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\x09-\x0d\x20\x85\xa0"


def splitter(pattern: str):
    """A function from a text to its pieces. Texts up to U+017F take an equal pattern of the faster standard library."""
    # White space as in the tokenizer's own engine, which leaves out the separators U+001C to U+001F.
    general = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    if pattern != public_tokenizers.PATTERN:
        return general.findall
    near = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACES}{LETTERS}{NUMBERS}]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]")
    fast, far = re.compile(near), re.compile("[^\x00-ſ]")
    return lambda text: general.findall(text) if far.search(text) else fast.findall(text)


class Vocabulary:
    """Token bytes by id, and for each pair of tokens whose bytes together are a token, that token's id, which is its rank."""

    def __init__(self, file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}
        size = max(self.ranks.values()) + 1
        if size > 1 << 16:
            raise ValueError("ids must be below 65536")
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        pairs = [(self.ranks[t[:i]] << 16 | self.ranks[t[i:]], rank) for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NEVER, dtype=np.int32)
        keys, values = (np.array([p[i] for p in pairs], dtype=np.int64) for i in (0, 1))
        at = self.slot(keys)
        while len(keys):  # of the pairs that want a free slot one gets it; the others move on
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            here = self.keys[at] == keys
            self.values[at[here]] = values[here]
            keys, values, at = keys[~here], values[~here], (at[~here] + 1) & ((1 << self.bits) - 1)

        ids = self.byte_ids
        self.byte_pairs = self.rank(np.repeat(ids, 256), np.tile(ids, 256))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges into, or NEVER. Ids below 0 are padding."""
        out = np.full(left.shape, NEVER, dtype=np.int32)
        asked = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[asked].astype(np.int64) << 16 | right.ravel()[asked]
        at = self.slot(keys)
        flat = out.ravel()
        while len(asked):
            held = self.keys[at]
            found = held == keys
            flat[asked[found]] = self.values[at[found]]
            go_on = ~found & (held >= 0)
            asked, keys, at = asked[go_on], keys[go_on], (at[go_on] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(left.shape)

    def merge_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        inside = np.arange(width) < lengths[:, None]
        ids = np.full((n, width), -1, dtype=np.int32)
        raw = np.zeros((n, width), dtype=np.int32)
        raw[inside] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ids[inside] = self.byte_ids[raw[inside]]
        ranks = np.full((n, width), NEVER, dtype=np.int32)
        ranks[:, :-1] = np.where(inside[:, 1:], self.byte_pairs[raw[:, :-1] << 8 | raw[:, 1:]], NEVER)
        rows, out = np.arange(n), [None] * n
        while len(rows):
            best = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), best]
            over = least == NEVER
            if over.any():
                for i in np.flatnonzero(over):
                    out[rows[i]] = ids[i][ids[i] >= 0]
                go_on = ~over
                rows, ids, ranks, best, least = rows[go_on], ids[go_on], ranks[go_on], best[go_on], least[go_on]
                if not len(rows):
                    break
            # Every row loses the right half of its pair, so all rows close up together and the matrix gets narrower by a column.
            at, width = np.arange(len(rows)), ids.shape[1] - 1
            stays = np.ones(ids.shape, dtype=bool)
            stays[at, best + 1] = False
            ids, ranks = ids[stays].reshape(-1, width), ranks[stays].reshape(-1, width)
            ids[at, best] = least
            right = np.where(best + 1 < width, ids[at, np.minimum(best + 1, width - 1)], -1)
            left = np.where(best > 0, ids[at, np.maximum(best - 1, 0)], -1)
            both = self.rank(np.concatenate([least, left]), np.concatenate([right, least]))
            ranks[at, best] = both[: len(rows)]
            some = np.flatnonzero(best > 0)
            ranks[some, best[some] - 1] = both[len(rows) + some]
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges of one long piece, by a linked list and a heap of (rank, place)."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        first = self.rank(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NEVER]
        heapq.heapify(heap)
        token, ranks = self.tokens, self.ranks
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (found := ranks.get(token[ids[x]] + token[ids[y]])) is not None:
                    heapq.heappush(heap, (found, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = np.array([rank], dtype=np.int32)
            elif len(piece) > MATRIX_WIDTH:
                out[i] = self.merge_long(piece)
            else:
                buckets.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, own in buckets.items():
            step = max(1, 200_000 // width)
            for k in range(0, len(own), step):
                some = own[k : k + step]
                for i, ids in zip(some, self.merge_matrix([pieces[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and the number of bytes of each."""
        lengths = self.lengths[ids]
        return self.bytes[gather(self.offsets[ids], lengths)], lengths


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


@lru_cache(maxsize=2)
def vocabulary(file: bytes) -> Vocabulary:
    return Vocabulary(file)


class Encoder:
    """Encodes lists of texts, remembering pieces in between."""

    def __init__(self, known: Vocabulary, pattern: str):
        self.known, self.split = known, splitter(pattern)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.starts, self.lengths, self.flat = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each text."""
        split = [self.split(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.index)
        if new:
            if len(self.index) + len(new) > KNOWN_PIECES and self.index:
                self.forget()
                new = set(chain.from_iterable(split))
            order = sorted(new)
            found = self.known.encode_pieces([p.encode() for p in order])
            self.index.update(zip(order, range(len(self.lengths), len(self.lengths) + len(order)), strict=True))
            lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, *found])
            self.starts = np.cumsum(self.lengths) - self.lengths
        n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(n.sum()))
        lengths = self.lengths[at]
        ids = self.flat[gather(self.starts[at], lengths)].astype(np.int32)
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(n)
        counts = upto[ends] - upto[ends - n]
        if any(len(p) > KNOWN_LENGTH for p in new):
            self.forget()
        return ids, counts


@lru_cache(maxsize=2)
def encoder(file: bytes, pattern: str) -> Encoder:
    """One for each Python worker, so that pieces are known from one task to the next."""
    return Encoder(vocabulary(file), pattern)


def joined_bytes(known: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The decoded bytes of each row, of the ids of all rows and the number of each row's."""
    raw, lengths = known.decode(ids)
    upto = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.concatenate([[0], np.cumsum(counts)])
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(upto[ends].astype(np.int32)), pa.py_buffer(raw)])


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    start = held = end = 0
    for end, size in enumerate(sizes, 1):
        held += size
        if held >= most:
            yield start, end
            start, held = end, 0
    if start < end:
        yield start, end


def read_vocabulary(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read()


def encode(df: DataFrame, text_column: str = "text", ids_column: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN, bytes_column: str | None = None) -> DataFrame:
    """df with a column of token ids (array of int) in place of the text; with bytes_column also what decode() makes of the ids.

    Decoding in the same task takes half as many Python workers as decode() behind encode().

    path: a file of ranks on the driver's machine; it is read once and sent to the executors (about 1 MB). Special tokens are not
    recognised: their strings are ordinary text. Null and empty texts have no ids. Other columns stay as they are, but one of the
    name ids_column is replaced; repeated rows are encoded alike and an empty table gives an empty result.
    """
    ship(df.sparkSession)
    file = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    others = [c for c in df.columns if c not in (text_column, ids_column, bytes_column)]
    decoded = [F.lit(None).cast("binary").alias(bytes_column)] if bytes_column else []
    schema = df.select(*[F.col(f"`{c}`") for c in others], F.lit(None).cast("array<int>").alias(ids_column), *decoded).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file.value, pattern)
        for batch in batches:
            texts = batch.column(len(others))
            sizes = np.nan_to_num(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), nan=0)
            for start, end in slices(sizes.tolist(), SLICE):
                part = batch.slice(start, end - start)
                ids, counts = own.encode([t or "" for t in part.column(len(others)).to_pylist()])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
                columns, names = [*part.columns[: len(others)], lists], [*others, ids_column]
                if bytes_column:
                    columns, names = [*columns, joined_bytes(own.known, ids, counts)], [*names, bytes_column]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_column}`").cast("string").alias(text_column)).mapInArrow(giving_back(run), schema)


def decode(df: DataFrame, ids_column: str = "ids", bytes_column: str = "decoded", path: str | None = None) -> DataFrame:
    """df with a column of the decoded bytes (binary) beside the ids; null ids give no bytes. Ids outside the vocabulary fail."""
    ship(df.sparkSession)
    file = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    others = [c for c in df.columns if c not in (ids_column, bytes_column)]
    schema = df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{ids_column}`").cast("array<int>").alias(ids_column), F.lit(None).cast("binary").alias(bytes_column)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(file.value)
        for batch in batches:
            counts = np.nan_to_num(pa.compute.list_value_length(batch.column(len(others))).to_numpy(zero_copy_only=False), nan=0)
            for start, end in slices(counts.tolist(), SLICE // 3):
                part = batch.slice(start, end - start)
                ids = part.column(len(others)).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*part.columns, joined_bytes(known, ids, counts[start:end].astype(np.int64))], names=[*others, ids_column, bytes_column])

    return df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{ids_column}`").cast("array<int>").alias(ids_column)).mapInArrow(giving_back(run), schema)


def digests(df: DataFrame, ids_column: str = "ids", bytes_column: str = "decoded") -> DataFrame:
    """df with n_tokens and the SHA-256 digests of its ids and decoded bytes, in place of both.

    Null ids or bytes have null digests, empty ones those of nothing. Columns of df named like the three new ones are replaced; repeated
    rows keep a row each and an empty table gives an empty result.
    """
    ids = F.col(f"`{ids_column}`")
    made = {"n_tokens": F.size(ids).cast("long"), "ids_sha256": F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256), "decoded_sha256": F.sha2(F.col(f"`{bytes_column}`"), 256)}
    others = [F.col(f"`{c}`") for c in df.columns if c not in (ids_column, bytes_column, *made)]
    return df.select(*others, *[c.alias(n) for n, c in made.items()])
