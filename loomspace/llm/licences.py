"""License scans by template-markup matching.

A template is license wording with markup: `<<beginOptional>> ... <<endOptional>>` may be left out, and
`<<var;match=a|b c>>` or `<<var;words=0-5>>` may be replaced by one of the listed wordings or by any words of that number. Each
template is compiled to a nondeterministic automaton over word ids; a text is accepted where all mandatory wording
matches exactly. Automata start only at words that can begin their template, in documents that hold every mandatory
word of it.

Beside the templates, fixed phrases are found as consecutive words and counted.

Defined results: null or empty text has no words and no label; repeated rows each get their own result; texts of any
length are scanned whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import id_text
from ._text import ALNUM, LOWER, RangeHash, blocks, same_bytes

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wording of public licenses, as templates share it.
_BSD_TERMS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<var;words=0-1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<var;words=0-1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution "
)
_BSD_NAMES = (
    "<<var;words=0-1>> neither the <<var;match=name|names>> of <<var;words=1-8>> <<var;match=nor the names of its|nor the names of|nor its>> contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission "
)
_BSD_END = "this software is provided by <<var;words=1-8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_GPL = "<<beginOptional>>this program is free software<<endOptional>> you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation "
_LATER = "either version {} of the license or at your option any later version"
_MPL = "this source code form is subject to the terms of the mozilla public license v {} if a copy of the mpl was not distributed with this file you can obtain one at <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> mozilla org mpl {}"
_CC = "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<var;match=cc by{0}|creative commons attribution{1}>> {2} <<beginOptional>>international<<endOptional>>"

# Public license notices and texts with markup. The whole of a text, with what must follow a list of
# conditions, tells licenses apart that begin alike.
TEMPLATES = {
    "0bsd": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties",
    "agpl-3.0-or-later": _GPL.format("affero general public license") + _LATER.format(3),
    "all-rights-reserved": "copyright <<beginOptional>>c<<endOptional>> <<var;words=1-8>> all rights reserved",
    "apache-2.0": "licensed under the <<beginOptional>>terms of the<<endOptional>> apache license <<beginOptional>>version<<endOptional>> 2 0",
    "artistic-2.0": "<<var;match=licensed|released|distributed>> under <<beginOptional>>the terms of<<endOptional>> the artistic license <<beginOptional>>version<<endOptional>> 2 0",
    "bsd-2-clause": _BSD_TERMS + _BSD_END,
    "bsd-3-clause": _BSD_TERMS + _BSD_NAMES + _BSD_END,
    "bsd-4-clause": _BSD_TERMS + "<<var;words=0-1>> all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by <<var;words=1-12>> " + _BSD_NAMES + _BSD_END,
    "bsl-1.0": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    "cc-by-4.0": _CC.format("", "", "4 0"),
    "cc-by-nc-4.0": _CC.format(" nc", " noncommercial", "4 0"),
    "cc-by-nc-nd-4.0": _CC.format(" nc nd", " noncommercial noderivatives", "4 0"),
    "cc-by-nc-sa-4.0": _CC.format(" nc sa", " noncommercial sharealike", "4 0"),
    "cc-by-nd-4.0": _CC.format(" nd", " noderivatives", "4 0"),
    "cc-by-sa-3.0": _CC.format(" sa", " sharealike", "3 0"),
    "cc-by-sa-4.0": _CC.format(" sa", " sharealike", "4 0"),
    "cc0-1.0": "<<var;match=cc0|creative commons zero|creative commons cc0>> <<beginOptional>>v1<<endOptional>> <<beginOptional>>1<<endOptional>> <<beginOptional>>0<<endOptional>> universal",
    "epl-2.0": "this program and the accompanying materials are made available under the terms of the eclipse public license <<var;match=2 0|v 2 0|v2 0|version 2 0>>",
    "gpl-2.0": "licensed under the gnu general public license <<beginOptional>>version<<endOptional>> <<var;match=2|v2>>",
    "gpl-2.0-only": _GPL.format("general public license") + "<<var;match=version 2 only|version 2 of the license only>>",
    "gpl-2.0-or-later": _GPL.format("general public license") + _LATER.format(2),
    "gpl-3.0": "licensed under the gnu general public license <<beginOptional>>version<<endOptional>> <<var;match=3|v3>>",
    "gpl-3.0-only": _GPL.format("general public license") + "<<var;match=version 3 only|version 3 of the license only>>",
    "gpl-3.0-or-later": _GPL.format("general public license") + _LATER.format(3),
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-2.1-or-later": _GPL.replace("program", "library").format("lesser general public license") + _LATER.format("2 1"),
    "lgpl-3.0-or-later": _GPL.replace("this program", "<<var;match=this library|this program>>").format("lesser general public license") + _LATER.format(3),
    "mit": "<<var;match=released|licensed|distributed|available>> under the <<beginOptional>>terms of the<<endOptional>> mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software",
    "mpl-2.0": _MPL.format("2 0", "2 0"),
    "ms-pl": "<<var;match=licensed|released|distributed>> under the <<beginOptional>>terms of the<<endOptional>> microsoft public license",
    "postgresql": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    "wtfpl": "do what the <<var;words=1-1>> you want to public license",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    "spdx-tag": "spdx license identifier <<var;words=1-1>>",
}
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text: str) -> list[str]:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


class Automaton:
    """A template over word ids. ``step[state]`` lists (word id, or -1 for any word; next state); free moves are closed over."""

    def __init__(self, template: str, number):
        self.step: list[list[tuple[int, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.must: set[int] = set()
        at, depth = 0, []
        for part in re.split(r"(<<[^>]*>>)", template):
            if part == "<<beginOptional>>":
                depth.append(at)
            elif part == "<<endOptional>>":
                at = self._join(at)
                self.free[depth.pop()].append(at)
            elif m := re.fullmatch(r"<<var;match=(.*)>>", part):
                ends = []
                for words in m[1].split("|"):
                    ends.append(self._chain(at, words, number))
                at = self._new()
                for e in ends:
                    self.free[e].append(at)
            elif m := re.fullmatch(r"<<var;words=(\d+)-(\d+)>>", part):
                exits = []
                for k in range(int(m[2]) + 1):
                    if k >= int(m[1]):
                        exits.append(at)
                    if k < int(m[2]):
                        new = self._new()
                        self.step[at].append((-1, new))
                        at = new
                at = self._new()
                for e in exits:
                    self.free[e].append(at)
            else:
                at = self._chain(at, part, number)
                if not depth:
                    self.must |= {number(w) for w in split(part)}
        self.end = at
        self.closed = [self._closure(s) for s in range(len(self.step))]
        self.starts = {w for s in self.closed[0] for w, _ in self.step[s]}

    def _new(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1

    def _join(self, at: int) -> int:
        new = self._new()
        self.free[at].append(new)
        return new

    def _chain(self, at: int, words: str, number) -> int:
        for w in split(words):
            new = self._new()
            self.step[at].append((number(w), new))
            at = new
        return at

    def _closure(self, s: int) -> frozenset[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def accepts(self, ids: list[int], at: int) -> int | None:
        """The end of the shortest match that starts at ``at``, or None."""
        states = self.closed[0]
        while self.end not in states:
            if at == len(ids):
                return None
            w, moved = ids[at], set()
            for s in states:
                for need, t in self.step[s]:
                    if need in (w, -1):
                        moved |= self.closed[t]
            if not moved:
                return None
            states, at = moved, at + 1
        return at


class Scanner:
    """Phrases and compiled templates; word ids are those of the words that they use, 0 is any other word."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.ids: dict[str, int] = {}
        number = lambda w: self.ids.setdefault(w, len(self.ids) + 1)
        self.phrases = [([number(w) for w in split(p)], label) for p, label in phrases.items()]
        self.automata = {k: Automaton(t, number) for k, t in templates.items()}
        for k, a in self.automata.items():
            if -1 in a.starts or a.end in a.closed[0]:
                raise ValueError(f"template {k} must begin with wording")
        words = list(self.ids)
        data = np.frombuffer("".join(words).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) for w in words])
        h = RangeHash(data)(ends - [len(w.encode()) for w in words], ends)
        order = np.argsort(h)
        self.keys, self.values = h[order], np.arange(1, len(words) + 1)[order]
        self.data, self.ends = data, ends[order]
        self.sizes = np.array([len(w.encode()) for w in words])[order]
        self.quick = np.zeros(1 << 16, bool)
        self.quick[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The numbers of the words of lower-case ``data``; hashes choose, bytes decide."""
        h, out = RangeHash(data)(start, end), np.zeros(len(start), np.int64)
        at = np.flatnonzero(self.quick[(h & np.uint64(0xFFFF)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = (self.keys[k] == h[at]) & (self.sizes[k] == end[at] - start[at])
        at, k = at[same], k[same]
        same = same_bytes(data, start[at], self.data, self.ends[k] - self.sizes[k], self.sizes[k])
        out[at[same]] = self.values[k[same]]
        return out

    def document(self, ids: np.ndarray) -> tuple[list[int], set[str], set[str]]:
        """Places of phrases (repeated if several start there), their labels, and the labels of accepted templates."""
        places, base, found = [], set(), set()
        present = set(np.unique(ids).tolist())
        for words, label in self.phrases:
            n = len(ids) - len(words) + 1
            if n > 0 and present >= set(words):
                same = np.ones(n, bool)
                for k, w in enumerate(words):
                    same &= ids[k : k + n] == w
                if len(at := np.flatnonzero(same)):
                    places += at.tolist()
                    base.add(label)
        own = None
        for label, a in self.automata.items():
            if present >= a.must and present & a.starts:
                own = own or ids.tolist()
                if any(a.accepts(own, int(s)) is not None for s in np.flatnonzero(np.isin(ids, list(a.starts)))):
                    found.add(label)
        return places, base, found


@lru_cache(4)
def scanner(templates: tuple, phrases: tuple) -> Scanner:
    return Scanner(dict(templates), dict(phrases))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Per document: words, places of base phrases, labels. ``score`` is 1 where a template's mandatory wording matches,
    0.5 where only phrases do, else 0."""
    key = tuple(sorted(templates.items())), tuple(phrases.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(*key)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for block in blocks(batch.column(1)):
                a, b, first = block.words(ALNUM, True)
                n = s.numbers(LOWER[block.data], a, b)
                known = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(n > 0)])[first]))
                at = set(known.tolist())
                for d in range(block.n):
                    own = n[first[d] : first[d + 1]]
                    places, base, found = s.document(own) if d in at else ([], set(), set())
                    rows.append((ids[block.first + d], len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if found else 0.5 if base else 0.0))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, types)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return id_text(docs).mapInArrow(run, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
