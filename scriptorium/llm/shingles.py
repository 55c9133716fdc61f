"""Sets of hashed word shingles, computed in numpy for many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from scriptorium.llm._common import SPACE_CHARS

CHUNK = 1_000_000
U = np.uint64
LOWER = bytes(range(256)).lower()
IN_WORD = np.array([chr(b) not in SPACE_CHARS for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits each depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_powers = np.cumprod(np.full(4096, 0xD6E8FEB86659FD93, dtype=np.uint64))


def powers(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(2 * n, _powers[0], dtype=np.uint64))
    return _powers


def hashed(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its shingles."""
    raw = np.frombuffer(b" ".join([*texts, b""]).translate(LOWER), dtype=np.uint8)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    edge = np.diff(np.concatenate([[False], IN_WORD[raw], [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    upto = np.searchsorted(starts, ends_of_texts)  # words up to each text's end
    if not len(starts):
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    lengths = ends - starts
    place = np.arange(len(raw)) - np.repeat(np.concatenate([starts, [len(raw)]]), np.diff(np.concatenate([[0], starts[1:], [len(raw)], [len(raw)]])))
    longest = int(lengths.max())
    place = np.clip(place, 0, longest)  # white space, whose place counts for nothing, may lie far behind the last word
    own = np.where(IN_WORD[raw], BYTES[raw] * powers(longest + 1)[place], U(0))
    word = mix(np.add.reduceat(own, starts) + lengths.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    run = word
    for k in range(1, width):
        run = mix(run[: len(run) - 1] * U(0xD1342543DE82EF95) + word[k:]) if len(run) > 1 else run[:0]
    out, before = [], 0
    for end in upto.tolist():
        n = end - before
        if n >= width:
            own_run = np.sort(run[before : end - width + 1])
            out.append(own_run[np.concatenate([[True], own_run[1:] != own_run[:-1]])])
        elif n:
            some = U(n)
            for w in word[before:end]:
                some = mix(np.array([some], dtype=np.uint64) * U(0xA0761D6478BD642F) + w)[0]
            out.append(np.array([some], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        before = end
    return out


def sets(texts: Iterable[bytes | None], width: int) -> Iterator[np.ndarray]:
    """hashed() over chunks of bounded size; null texts have empty sets."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text or b"")
        size += len(held[-1])
        if size >= CHUNK:
            yield from hashed(held, width)
            held, size = [], 0
    if held:
        yield from hashed(held, width)


def fingerprint(own: np.ndarray) -> int:
    """A signed 64-bit name for a set."""
    return int(mix(np.array([mix(own ^ U(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) + U(len(own))], dtype=np.uint64)).view(np.int64)[0])
