"""License scans by template-markup matching.

A template is license wording with optional regions, [[ ... ]], and replaceable regions, {{least-most}}, that stand for any so many
words. It is compiled into a token automaton whose edges carry words, any word, or nothing. A text is accepted where some run of its
words leads from the first state to the last, so that all mandatory wording stands there exactly, in order. Phrases are looked for
beside it. A task reads each text once as bytes; only texts with a template's rarest mandatory word are run through its automaton.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import ship

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: (label, template, a mandatory word that few other texts have); short notices first, then whole licenses.
TEMPLATES = (
    ("apache-2.0", "[[{{0-2}} is]] licensed under [[the terms of]] the Apache License [[Version]] 2.0 [[the License]]", "apache"),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[Creative Commons]] [[license]] CC BY NC 4.0 [[International]]", "nc"),
    ("cc-by-nc-4.0", "licensed under [[a]] Creative Commons Attribution NonCommercial 4.0 International [[Public]] License", "noncommercial"),
    ("cc-by-4.0", "licensed under [[a]] Creative Commons Attribution 4.0 International [[Public]] License", "attribution"),
    ("copyright", "Copyright [[c]] {{1-8}} All rights reserved", "copyright"),
    ("gpl-3.0", "[[This {{1-2}} is]] licensed under the [[terms of the]] GNU General Public License [[as published by the Free Software Foundation]] [[either]] version 3 [[of the License]] [[or [[at your option]] any later version]]", "gnu"),
    ("isc", "Permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "hereby"),
    ("mit", "Released under the [[terms of the]] MIT License", "mit"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the Software]] to deal in the Software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and [[or]] sell copies of the Software [[and to permit persons to whom the Software is furnished to do so]] subject to the following conditions", "sublicense"),
    ("mit", """Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the Software to deal in the Software without
        restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the Software and to permit persons to whom the Software is furnished
        to do so subject to the following conditions The above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the
        Software THE SOFTWARE IS PROVIDED AS IS WITHOUT WARRANTY OF ANY KIND EXPRESS OR IMPLIED INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT IN NO EVENT SHALL {{2-8}} BE LIABLE FOR ANY CLAIM DAMAGES OR OTHER LIABILITY WHETHER IN AN ACTION OF CONTRACT TORT OR OTHERWISE ARISING FROM OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""", "noninfringement"),
    ("bsd", """Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] Redistributions of source code must retain
        the above copyright notice this list of conditions and the following disclaimer [[2]] Redistributions in binary form must reproduce the above copyright notice this list of conditions and the
        following disclaimer in the documentation and or other materials provided with the distribution [[[[3]] Neither the name of {{1-8}} nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission]] THIS SOFTWARE IS PROVIDED BY {{2-10}} AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES INCLUDING BUT NOT
        LIMITED TO THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED""", "redistributions"),
    ("isc", """Permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice
        appear in all copies THE SOFTWARE IS PROVIDED AS IS AND {{2-8}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS""", "disclaims"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License [[v]] 2.0", "mozilla"),
)
#: Bytes of words: digits, letters, and all of UTF-8 beyond ASCII; the rest becomes spaces.
IN_WORDS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def wording(text: str) -> bytes:
    """The text's words in lower case with spaces between; more than one space is one."""
    return text.encode("utf-8", "surrogatepass").translate(IN_WORDS)


@dataclass
class Automaton:
    """words[s] is the word that leaves state s (None: any), to s + 1; skips[s] are the states reached from s without a word."""

    label: str
    anchor: bytes
    words: list
    skips: list
    mandatory: list  # for each state, the share of mandatory words that stand before it

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def run(self, words: list[bytes]) -> tuple[bool, float]:
        """Whether some run of words is accepted, and the largest share of mandatory words that was met in order."""
        last, best = len(self.words), 0.0
        first, now = self.closure({0}), set()
        for word in words:
            now = self.closure({s + 1 for s in now | first if s < last and self.words[s] in (None, word)})
            if now:
                best = max(best, max(self.mandatory[s] for s in now))
                if last in now:
                    return True, 1.0
        return False, best


def compiled(label: str, template: str, anchor: str | None = None) -> Automaton:
    """The automaton of a template. anchor: a mandatory word, the longest one if none is named; texts without it are not run."""
    words: list = []
    skips: list = [set()]
    counts, opened = [0], []

    def edge(word, counted: int) -> None:
        words.append(word)
        skips.append(set())
        counts.append(counts[-1] + counted)

    for part in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\[\]{}]+", template):
        if part == "[[":
            opened.append(len(words))
        elif part == "]]":
            skips[opened.pop()].add(len(words))
        elif part[:2] == "{{":
            least, most = map(int, part[2:-2].split("-"))
            begin = len(words)
            for _ in range(most):
                edge(None, 0)
            for k in range(least, most):
                skips[begin + k].add(begin + most)
        else:
            for word in wording(part).split():
                edge(word, not opened)
    if opened or not counts[-1]:
        raise ValueError(f"the template of {label} has an open region or no mandatory word")
    mandatory = [w for w, before, after in zip(words, counts, counts[1:], strict=False) if after > before]
    own = wording(anchor).strip() if anchor else max(mandatory, key=len)
    if own not in mandatory:
        raise ValueError(f"{anchor} is no mandatory word of the template of {label}")
    return Automaton(label, own, words, skips, [c / counts[-1] for c in counts])


@lru_cache(maxsize=4)
def automata(templates: tuple = TEMPLATES) -> list[Automaton]:
    return [compiled(*t) for t in templates]


@lru_cache(maxsize=1)
def phrase_words() -> list[tuple[list[bytes], str, re.Pattern]]:
    return [(w, label, re.compile(b"(?<![^ ])" + b" +".join(w) + b"(?![^ ])")) for w, label in ((p.encode().split(), v) for p, v in PHRASES.items())]


def scan_text(text: str | None, templates: tuple = TEMPLATES) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    held = wording(text or "")
    words = held.split()
    places, base = [], set()
    for phrase, label, pattern in phrase_words():
        if pattern.search(held):
            n = len(phrase)
            found = [i for i, w in enumerate(words) if w == phrase[0] and words[i : i + n] == phrase]
            places += found
            base.add(label)
    labels, score = set(base), 0.0
    for automaton in automata(templates):
        if automaton.anchor in held and automaton.anchor in words:
            accepted, share = automaton.run(words)
            score = max(score, share)
            if accepted:
                labels.add(automaton.label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


FOUND = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}


def scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: tuple = TEMPLATES) -> DataFrame:
    """The id, then n_words, n_base, first_word, last_word, base_labels, labels and score of every row's text.

    templates: (label, template) or (label, template, anchor) each; one that is ill-formed fails at once. score: 1 where a template is accepted, else the largest share of a template's mandatory words met in order, among templates whose
    anchor word the text has; 0 without any. Null and empty texts have no words, labels or places. Labels are distinct, sorted and
    comma-joined. Repeated rows are scanned alike; an empty table gives an empty result; other columns are left out.
    """
    ship(df.sparkSession)
    templates = tuple(tuple(t) for t in templates)
    automata(templates)
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(scan_text(t, templates) for t in batch.column(1).to_pylist()), strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(found, kinds, strict=True)]], names=[id_column, *FOUND])

    held = df.alias("input").select(F.col(f"input.`{id_column}`").alias(id_column), F.col(f"input.`{text_column}`").cast("string").alias("_text"))
    kind = held.schema[id_column].dataType.simpleString()
    return held.mapInArrow(run, ", ".join([f"`{id_column}` {kind}", *[f"{c} {k}" for c, k in FOUND.items()]]))
