"""Licence scans: matching statistics against a generalised suffix automaton of licence tokens.

The automaton of all templates reads a text's tokens and knows, at every place, the longest stretch ending there that some
template holds. Long stretches are chained per template, in the order of both, and the chain's share of the template tells
how much of it the text covers. Literal phrases are counted beside it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, texts_of

# Phrases with their labels, and notices of common licences.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
}
#: Tokens of a stretch that counts, tokens a chain may skip, and the share of a template that names it.
LONG, GAP, SHARE = 5, 60, 0.3

_CLEAN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


class Automaton:
    """The suffix automaton of all templates, read one after another from the root."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = list(templates)
        words = [t.encode().split() for t in templates.values()]
        self.sizes = [len(w) for w in words]
        phrase_words = [w for p in PHRASES for w in p.encode().split()]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys([x for w in words for x in w] + phrase_words))}
        self.phrases = [([self.vocabulary[w] for w in p.encode().split()], label) for p, label in PHRASES.items()]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, tokens in enumerate(words):
            last = 0
            for place, w in enumerate(tokens):
                last = self._extend(last, self.vocabulary[w])
                self.ends[last].add((t, place))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, moves: dict[int, int], link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:  # an earlier template has this prefix
            return self._fitted(last, self.next[last][symbol], symbol)
        new, p = self._state({}, 0, self.length[last] + 1), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._fitted(p, self.next[p][symbol], symbol)
        return new

    def _fitted(self, p: int, q: int, symbol: int) -> int:
        """The state of p's stretch and the symbol: q itself, or split off where q stands for longer ones too."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def stretches(self, ids: list[int], base: int) -> list[tuple[int, int, int]]:
        """(first token, tokens, state) of the longest stretches of LONG tokens or more that no longer one contains."""
        out: list[tuple[int, int, int]] = []
        state = size = 0
        for k, symbol in enumerate([*ids, -1]):
            before, held = state, size
            while state > 0 and symbol not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if held >= LONG and symbol not in self.next[before]:
                out.append((base + k - held, held, before))
            if symbol in self.next[state]:
                state, size = self.next[state][symbol], size + 1
            else:
                state = size = 0
        return out

    def coverage(self, found: list[tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
        """By template: (tokens covered, first token, end) of the best chain, ascending in text and template."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for first, size, state in found:
            for t, place in self.ends[state]:
                by_template.setdefault(t, []).append((first, size, place - size + 1))
        out = {}
        for t, parts in by_template.items():
            parts.sort()
            best: list[tuple[int, int, int]] = []
            for k, (first, size, at) in enumerate(parts):
                score, begin = size, first
                # A stretch is no longer than the template, so none that begins earlier reaches into the gap.
                for m in range(bisect_left(parts, (first - GAP - self.sizes[t],)), k):
                    f, s, a = parts[m]
                    # overlaps of neighbouring stretches count once
                    over = max(0, f + s - first, a + s - at)
                    if f < first and a < at and first - f - s <= GAP and best[m][0] + size - over > score:
                        score, begin = best[m][0] + size - over, best[m][1]
                best.append((score, begin, first + size))
            out[t] = max(best, key=lambda b: (b[0], -b[1]))
        return out


def _scanned(automaton: Automaton) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(words: list[bytes]) -> tuple[int, int, int | None, int | None, str, str, float, list[str]]:
        ids = np.fromiter(map(automaton.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        places, base = [], set()
        for phrase, label in automaton.phrases:
            at = np.flatnonzero(ids[: max(0, len(ids) - len(phrase) + 1)] == phrase[0])
            for k, w in enumerate(phrase[1:], 1):
                at = at[ids[at + k] == w]
            if len(at):
                base.add(label)
                places += at.tolist()
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])))
        starts, stops = edges[::2], edges[1::2]
        found = [x for b, e in zip(starts, stops, strict=True) if e - b >= LONG for x in automaton.stretches(ids[b:e].tolist(), int(b))]
        labels, share, spans = set(base), 0.5 if base else 0.0, []
        for t, (covered, begin, end) in sorted(automaton.coverage(found).items()):
            part = min(1.0, covered / automaton.sizes[t])
            share = max(share, part)
            if part >= SHARE:
                labels.add(automaton.names[t])
                spans.append(f"{automaton.names[t]}:{begin}:{end}")
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), share, spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in portions(map(len, texts)):
                rows = [scan(t.translate(_CLEAN).split()) for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return run


def license_scan(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one row per row of documents.

    spans lists label:first:end of the template stretches, in tokens. score is the largest share of a template that the text
    covers, at least one half where a phrase stands. A null or empty text has no words, empty labels, score 0 and null places.
    Repeated rows and null ids are each answered; the texts pass through tasks one by one, without a shuffle. Only doc_id
    and text are read. An empty table gives an empty result.
    """
    texts = texts_of(documents)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>"
    return texts.mapInArrow(_scanned(Automaton(templates or TEMPLATES)), schema)
