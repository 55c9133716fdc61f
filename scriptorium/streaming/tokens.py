"""Token streams of a chat provider: server-sent events that arrive in chunks, over tables and over streams.

A chunk may end anywhere, inside a line or inside a character. What a stream needs from its past is the partial line, the usage so far and
whether it has ended, and that is its state: chunks are never put together. Each chunk gives the text that its lines complete.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scriptorium.operators.ordered import ordered_fold
from scriptorium.sources.shipping import ship

# Where a provider's chunk has its piece of the answer and its counts, the mark of a data line, and the payload that ends a stream.
CONTENT, USAGE, FIELDS = ("choices", 0, "delta", "content"), ("usage",), ("prompt_tokens", "completion_tokens")
DATA, DONE = "data: ", "[DONE]"
#: Characters around a payload that do not count.
BLANK = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


class Source(NamedTuple):
    """The paths of the text and of the usage object in a payload, and the names of its counts."""

    content: tuple = CONTENT
    usage: tuple = USAGE
    fields: tuple = FIELDS


class Progress(NamedTuple):
    """What is known of a stream: the line that has begun, whether a line was complete, whether it has ended, half of a character, counts."""

    partial: bytes = b""
    begun: bool = False
    done: bool = False
    half: str = ""
    counts: tuple = ()


def _not_json(_: str) -> None:
    raise ValueError


def at(value: object, path: tuple) -> object:
    """The value at a path of names and places, or None."""
    for step in path:
        if isinstance(step, int):
            value = value[step] if isinstance(value, list) and -1 < step < len(value) else None
        else:
            value = value.get(step) if isinstance(value, dict) else None
    return value


def payloads(partial: bytes, begun: bool, chunk: bytes | None) -> tuple[list, bytes, bool, bool]:
    """The JSON values of the data lines that a chunk completes, the line that has begun, whether any was complete, and whether the end came."""
    *lines, partial = (partial + (chunk or b"")).split(b"\n")
    values: list = []
    for raw in lines:
        line = raw.decode("utf-8", "replace")
        line, begun = line if begun else line.removeprefix("\ufeff"), True
        if not line.startswith(DATA):
            continue
        payload = line[len(DATA) :].strip(BLANK)
        if payload == DONE:
            return values, b"", True, True
        try:
            values.append(json.loads(payload, parse_constant=_not_json))
        except (ValueError, RecursionError):
            continue
    return values, partial, begun, False


def received(now: Progress, chunk: bytes | None, source: Source) -> tuple[Progress, str]:
    """The progress after a chunk, and the text of the data lines that it completes.

    A line ends with a line feed; one that is not data, or whose payload is no JSON, does nothing. Only a line whose whole payload is DONE
    ends the stream, and nothing behind it counts. Counts are kept field by field: the last number that is given. A surrogate pair that two
    pieces share is one character.
    """
    counts = dict(zip(source.fields, now.counts or (None,) * len(source.fields), strict=True))
    if now.done:
        return now, ""
    values, partial, begun, done = payloads(now.partial, now.begun, chunk)
    text = now.half
    for value in values:
        piece, usage = at(value, source.content), at(value, source.usage)
        text += piece if isinstance(piece, str) else ""
        for field in source.fields:
            n = at(usage, (field,))
            if isinstance(n, (int, float)) and not isinstance(n, bool) and abs(n) < 2**63:
                counts[field] = int(n)
    half = text[-1:] if not done and "\ud800" <= text[-1:] <= "\udbff" else ""
    whole = text[: len(text) - len(half)].encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return Progress(partial, begun, done, half, tuple(counts.values())), whole


def pieces(chunks: DataFrame, key: str, seq: str, chunk: str, source: Source = Source()) -> DataFrame:
    """key, seq, text, done and the counts after every chunk (text or binary) of every stream, in order of seq.

    Null chunks are empty; chunks of equal seq come in any order. Chunks are sorted by key and order, which spills, and pass through with
    one state, so a stream of any length takes the memory of a line. A line that never ends gives nothing.
    """
    rows = chunks.select(key, seq, F.col(chunk).cast("binary").alias("_chunk"))

    def step(now: Progress, x: dict) -> tuple[Progress, tuple]:
        now, text = received(now, x["_chunk"], source)
        return now, (text, now.done, *(now.counts))

    out = {"text": "string", "done": "boolean"} | dict.fromkeys(source.fields, "long")
    return ordered_fold(rows, key, [seq], ["_chunk"], [seq], Progress(), step, out)


def answers(found: DataFrame, key: str, seq: str, source: Source = Source()) -> DataFrame:
    """key, text, done, the counts and n_chunks of every stream, from its pieces; the text of an answer is one value."""
    last = [F.max_by(c, seq).alias(c) for c in ("done", *source.fields)]
    whole = F.expr(f"listagg(text, '') within group (order by `{seq}`)")
    return found.groupBy(key).agg(F.coalesce(whole, F.lit("")).alias("text"), *last, F.count("*").alias("n_chunks"))


def piece_stream(chunks: DataFrame, key: str, seq: str, chunk: str, source: Source = Source(), idle: str | None = None) -> DataFrame:
    """pieces() over a stream: rows as chunks arrive. Chunks of one micro-batch are put in order of seq; across them, arrival is the order.

    idle: milliseconds after which the state of a stream without new chunks goes, such as those of a connection that broke; None keeps it.
    With it, a query goes on looking for idle streams, so it takes a trigger by time and not one that ends with the input.
    """
    spark = chunks.sparkSession
    ship(spark)
    kinds = dict(chunks.dtypes)
    counts = "".join(f", `{f}` long" for f in source.fields)
    rows = chunks.select(key, seq, F.col(chunk).cast("binary").alias("_chunk"))

    def update(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = Progress()
        if state.exists:
            partial, begun, done, half, *so_far = state.get
            now = Progress(bytes(partial), begun, done, chr(half) if half else "", tuple(so_far))
        out = []
        for place, data in pd.concat(list(batches)).sort_values(seq, kind="stable")[[seq, "_chunk"]].itertuples(index=False):
            now, text = received(now, None if data is None else bytes(data), source)
            out.append((own[0], place, text, now.done, *now.counts))
        state.update((now.partial, now.begun, now.done, ord(now.half) if now.half else 0, *now.counts))
        if idle is not None:
            state.setTimeoutDuration(idle)
        found = pd.DataFrame(out, columns=[key, seq, "text", "done", *source.fields])
        yield found.astype(dict.fromkeys(source.fields, "Int64"))

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    out = f"`{key}` {kinds[key]}, `{seq}` {kinds[seq]}, text string, done boolean{counts}"
    return rows.groupBy(key).applyInPandasWithState(update, out, f"partial binary, begun boolean, done boolean, half int{counts}", "append", timeout)


def joined_deltas(chunks: DataFrame, key: str, seq: str, chunk: str, content: tuple = ("delta",), usage: tuple = ("usage",)) -> DataFrame:
    """key, text, usage and n_chunks of every stream, whatever counts it reports: usage is a JSON object with the last value of each field."""
    rows = chunks.select(key, seq, F.col(chunk).cast("binary").alias("_chunk"))

    def step(now: tuple, x: dict) -> tuple[tuple, tuple]:
        partial, begun, done, counts = now
        if done:
            return now, ("", counts)
        values, partial, begun, done = payloads(partial, begun, x["_chunk"])
        found = [at(v, usage) for v in values]
        merged = json.loads(counts) if counts else {}
        for own in found:
            merged |= {k: v for k, v in own.items() if v is not None} if isinstance(own, dict) else {}
        counts = json.dumps(merged, separators=(",", ":")) if merged else None
        text = "".join(p for p in (at(v, content) for v in values) if isinstance(p, str))
        return (partial, begun, done, counts), (text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace"), counts)

    found = ordered_fold(rows, key, [seq], ["_chunk"], [seq], (b"", False, False, None), step, {"text": "string", "usage": "string"})
    whole = F.coalesce(F.expr(f"listagg(text, '') within group (order by `{seq}`)"), F.lit(""))
    return found.groupBy(key).agg(whole.alias("text"), F.max_by("usage", seq).alias("usage"), F.count("*").alias("n_chunks"))
