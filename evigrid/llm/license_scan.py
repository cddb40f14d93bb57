"""License scans by template markup.

A template is license wording with regions in markup: [[optional words]] may be left out, {{n}} stands for up to n words
of any kind (a name, a year). It is compiled into a token automaton; a text matches where the automaton reaches its end,
that is where all mandatory words stand in order, with only these freedoms. Base phrases are found as plain word runs.

Words are runs of ASCII letters, digits and non-ASCII characters, after lower-casing A-Z. A text meets an automaton only
if it holds the template's longest mandatory run; whole texts are read, in short Arrow batches.

Null texts count as empty: no words, no hits, score 0. Rows are judged one by one, so repeated rows, ties and an empty
table need no care. Columns that docs has already keep their names; new ones get underscores.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, free_name, ship

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction "
    "including without limitation [[on]] the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall {{20}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
    "arising from out of or in connection with the software or the use or other dealings in the software"
)
ISC = (
    "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and {{20}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall {{20}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[1]] [[a]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[2]] [[b]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
BSD_NAMES = "[[3]] [[c]] neither the name of {{20}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
BSD_DISCLAIMER = (
    "this software is provided by {{20}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall {{20}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
    "arising in any way out of the use of this software even if advised of the possibility of such damage"
)

#: (label, template). Licences that are given by their wording have all of it: conditions and disclaimers too.
TEMPLATES = (
    ("mit", "[[this {{3}} is]] released under the mit license"),
    ("mit", MIT),
    ("mit", MIT.replace("noninfringement", "non infringement")),
    ("apache-2", "licensed under the apache license version 2 0 [[the license]]"),
    ("gpl-3", "this {{3}} is [[free software]] licensed under the [[terms of the]] gnu general public license [[gpl]] version 3"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or [[at your option]] any later version"),
    ("isc", ISC),
    ("isc", ISC.replace("disclaims", "disclaim")),
    ("bsd-2", f"{BSD} {BSD_DISCLAIMER}"),
    ("bsd-3", f"{BSD} {BSD_NAMES} {BSD_DISCLAIMER}"),
    # The version only: three words of any kind would take in "NonCommercial 4.0" and "ShareAlike 4.0".
    ("cc-by", "licensed under [[a]] [[the]] creative commons attribution [[cc by]] [[4]] [[0]] international [[public]] license"),
)

#: A-Z to a-z, other ASCII characters but a-z and 0-9 to blanks, all other bytes as they are.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())

#: U+2018 to U+201F in UTF-8.
QUOTES = re.compile(rb"\xe2\x80[\x98-\x9f]")


@dataclass(frozen=True)
class Automaton:
    """moves[state]: (word or None for any word, next state); skips[state]: states reached without a word."""

    label: str
    moves: tuple
    skips: tuple
    final: int
    anchor: bytes

    def closure(self, states: dict[int, int]) -> dict[int, int]:
        """states and all that they reach without a word; each with its earliest start."""
        todo = sorted(states.items(), key=lambda x: -x[1])
        while todo:
            state, begin = todo.pop()
            for to in self.skips[state]:
                if begin < states.get(to, begin + 1):
                    states[to] = begin
                    todo.append((to, begin))
        return states

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Spans (first word, word after the last) of matches; of matches that end together, the longest."""
        found, live = [], {}
        for i, word in enumerate(words):
            live.setdefault(0, i)
            live = self.closure(live)
            after: dict[int, int] = {}
            for state, begin in live.items():
                for want, to in self.moves[state]:
                    if (want is None or want == word) and begin < after.get(to, begin + 1):
                        after[to] = begin
            live = self.closure(after)
            if self.final in live:
                found.append((live[self.final], i + 1))
        return found


def compile_template(label: str, template: str) -> Automaton:
    moves, skips, opened, runs, run = [[]], [[]], None, [[]], True
    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        here = len(moves) - 1
        if part == "[[":
            opened, run = here, False
            runs.append([])
        elif part == "]]":
            skips[opened].append(here)
            opened, run = None, True
            runs.append([])
        elif part.startswith("{{"):
            n = int(part[2:-2])
            for k in range(n):
                moves[-1].append((None, len(moves)))
                skips[here + k].append(here + n)
                moves.append([])
                skips.append([])
            runs.append([])
        else:
            moves[-1].append((part.encode(), len(moves)))
            moves.append([])
            skips.append([])
            if run:
                runs[-1].append(part)
    anchor = " ".join(max(runs, key=lambda r: len(" ".join(r)))).encode()
    return Automaton(label, tuple(map(tuple, moves)), tuple(map(tuple, skips)), len(moves) - 1, anchor)


@lru_cache(maxsize=8)
def automata(templates: tuple) -> tuple[Automaton, ...]:
    return tuple(compile_template(*t) for t in templates)


def scan_text(text: bytes, phrases: tuple = tuple(PHRASES.items()), templates: tuple = TEMPLATES) -> tuple[int, list[tuple[str, str, int, int]]]:
    """Number of words, and hits: label, kind (base or template), first word, word after the last."""
    words = text.translate(WORD_BYTES).split()
    joined = b" %b " % b" ".join(words)
    hits = []
    for phrase, label in phrases:
        want = b" %b " % phrase.encode()
        at, seen, k = joined.find(want), 0, 0
        while at >= 0:
            k += joined.count(b" ", seen, at)
            seen = at
            hits.append((label, "base", k, k + phrase.count(" ") + 1))
            at = joined.find(want, at + 1)
    if b"\xe2\x80" in joined:  # typographic quotes count as part of words, but templates have none
        words = [QUOTES.sub(b"", w) for w in words]
        joined = b" %b " % b" ".join(words)
    for own in automata(templates):
        if b" %b " % own.anchor in joined:
            hits += [(own.label, "template", a, b) for a, b in own.find(words)]
    return len(words), hits


HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField(
            "hits",
            T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])),
        ),
    ]
)


def scan(spark: SparkSession, docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """docs with a struct column `scan`: n_words, and hits as an array of (label, kind, start, stop)."""
    ship(spark)
    bounded_batches(spark)
    phrases = tuple(phrases.items())
    hit = pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])

    @F.arrow_udf(HITS)
    def scan_batch(texts: pa.Array) -> pa.Array:
        out = [scan_text(t or b"", phrases, templates) for t in texts.to_pylist()]
        hits = pa.array([[dict(zip(("label", "kind", "start", "stop"), h, strict=True)) for h in hits] for _, hits in out], pa.list_(hit))
        return pa.StructArray.from_arrays([pa.array([n for n, _ in out], pa.int64()), hits], ["n_words", "hits"])

    return docs.withColumn(free_name(docs, "scan"), scan_batch(F.col(text).cast("binary")))
