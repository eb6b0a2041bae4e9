"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are cut into word n-grams and winnowed; an inverted index leads from a fingerprint to its places in the
templates. Every text looks up all its n-grams there, so any run of ``GRAM + WINDOW - 1`` words in common with a
template is found. Places on nearby diagonals form a candidate, which is aligned within a band around them.
Templates are lines, notices and whole licences; a match inside a longer one is part of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from hydroseries.llm.common import Buffer, WordIds, gram_hashes, hash64, map_batches, rows_of, sliding, texts

GRAM, WINDOW = 3, 2
#: A run of diagonals with fewer than this share of a template's fingerprints is not aligned; one is always needed.
LEAST_SHARE = 0.05
#: Of the words of a match, as many as this may lie in longer matches without its being part of them.
INSIDE = 0.9
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")

#: Lines and notices by which works are put under a licence.
NOTICES: dict[str, str] = {
    "AGPL-3.0/notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for "
        "more details."
    ),
    "All-Rights-Reserved/line": "All rights reserved.",
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "CC-BY-4.0/line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."
    ),
    "LGPL-2.1/notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later "
        "version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for "
        "more details."
    ),
    "MIT/line": "Released under the MIT License.",
    "MPL-2.0/notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}


def license_texts(folder: str | Path = Path(__file__).parent / "license_texts") -> dict[str, str]:
    """The whole texts of a folder, a file each, as templates ``name/text``."""
    return {f"{p.stem}/text": p.read_text(encoding="utf-8") for p in sorted(Path(folder).glob("*.txt"))}


TEMPLATES: dict[str, str] = NOTICES | license_texts()


class Index:
    """Inverted index of the templates' winnowed fingerprints."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = sorted(templates)
        self.words = [_WORD.findall(templates[n].encode().lower()) for n in self.names]
        places: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            grams = gram_hashes(np.array([hash64(w) for w in words], dtype=np.uint64), GRAM)
            if not len(grams):
                continue
            least = sliding(grams, min(WINDOW, len(grams)), np.minimum)
            for at in np.flatnonzero(np.isin(grams, least)).tolist():
                places.setdefault(int(grams[at]), []).append((t, at))
        self.places = places
        known = np.bincount([t for hits in places.values() for t, _ in hits], minlength=len(self.names))
        self.needed = np.maximum(1, (known * LEAST_SHARE).astype(int)).tolist()
        self.ids = [np.array([hash64(w) for w in words], dtype=np.uint64) for words in self.words]
        self.keys = np.array(sorted(places), dtype=np.uint64)

    def candidates(self, grams: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, lowest, highest start of the template in the text), by runs of nearby diagonals."""
        if not len(grams) or not len(self.keys):
            return
        slot = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        found: dict[int, list[int]] = {}
        for at in np.flatnonzero(self.keys[slot] == grams).tolist():
            for t, place in self.places[int(grams[at])]:
                found.setdefault(t, []).append(at - place)
        for t, starts in found.items():
            starts.sort()
            slack = 3 + len(self.words[t]) // 8
            ends = [i for i in range(1, len(starts)) if starts[i] - starts[i - 1] > slack]
            for i, j in zip([0, *ends], [*ends, len(starts)]):
                if j - i >= self.needed[t]:
                    yield t, starts[i], starts[j - 1]


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment with the template starting between words low and high of the text, give or take a band.

    Match 2, change -1, gap -1; words are ids. Returns matched words and the span of the text [from, to); the earliest of
    equal ones. A word of the template is one step over the whole band.
    """
    band = 3 + len(template) // 8
    left, right = low - band, high + band
    width, n = right - left + 1, len(text)
    best, best_end = (0, 0, -1), -1
    # Column d of row i compares template word i with text word left + d + i. A cell: score, matches, first word.
    score, matches, first = (np.zeros(width + 1, dtype=np.int64) for _ in range(3))
    first[:] = -1
    steps = np.arange(width, dtype=np.int64)
    for i, word in enumerate(template.tolist()):
        start, stop = max(0, -left - i), min(width, n - left - i)
        if start >= stop:
            score[:], matches[:], first[:] = 0, 0, -1
            continue
        here, d = slice(start, stop), steps[: stop - start]
        same = text[left + start + i : left + stop + i] == word
        s, m = score[here] + np.where(same, 2, -1), matches[here] + same
        f = np.where(same & (first[here] < 0), d + (left + start + i), first[here])
        above = slice(start + 1, stop + 1)  # the template's word is missing from the text
        up = score[above] - 1 > s
        s, m, f = np.where(up, score[above] - 1, s), np.where(up, matches[above], m), np.where(up, first[above], f)
        lifted = np.maximum(s, 0) + d  # the text has words more: the best cell to the left, less the steps from it
        source = np.maximum.accumulate(np.where(lifted == np.maximum.accumulate(lifted), d, 0))
        s, m, f = lifted[source] - d, m[source], f[source]
        live = s > 0
        score[:], matches[:], first[:] = 0, 0, -1
        score[here], matches[here], first[here] = np.where(live, s, 0), np.where(live, m, 0), np.where(live, f, -1)
        top = int(np.argmax(score[here]))
        if s[top] > best[0]:
            best, best_end = (int(s[top]), int(m[top]), int(f[top])), left + start + top + i + 1
    return best[1], best[2], best_end


def outermost(matches: list[tuple[int, int, int, int]], sizes: list[int], n_words: int) -> list[tuple[int, int, int, int]]:
    """Of the (template, matched, first, end) of a text those that are no part of longer ones.

    More matched words go first, then the greater share of the template, the earlier place, the earlier name. A match goes
    if ``INSIDE`` of its words lie in those before it.
    """
    if len(matches) < 2:
        return matches
    taken, kept = np.zeros(n_words, dtype=bool), []
    for m in sorted(matches, key=lambda m: (-m[1], -m[1] / sizes[m[0]], m[2], m[0])):
        if taken[m[2] : m[3]].sum() < INSIDE * (m[3] - m[2]):
            kept.append(m)
            taken[m[2] : m[3]] = True
    return sorted(kept, key=lambda m: (m[2], m[3], m[0]))


def scan_licenses(
    docs: DataFrame, templates: Mapping[str, str] | None = None, coverage: float = 0.75, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, license, matched_words, coverage, word_from, word_to, char_from, char_to: a row per place of a template.

    Words are runs of a-z, 0-9 and letters beyond ASCII, A-Z lower-cased; spans count such words, and code points of the text.
    ``coverage`` is the part of the template's words that the alignment matches. Texts that are null, empty or without a
    match give no row; repeated rows are reported each. Several places of one template in a text are rows of their own. A
    match of which nine tenths lie in longer matches is part of them and gives no row: BSD-3 is not BSD-2 as well. Runs with less
    than a twentieth of a template's fingerprints are not aligned, which no place with the share of words asked for can have unless
    foreign words are spread all through it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES))  # as large as the templates

    def run(batches):
        index, ids = shared.value, WordIds(hash64)
        names = ("doc_id", "license", "matched_words", "coverage", "word_from", "word_to", "char_from", "char_to")
        out = Buffer(*names)
        for who, text in rows_of(batches, "doc_id", "text"):
            if not text:
                continue
            low = text.lower()
            words = _WORD.findall(low)
            if len(words) < GRAM:
                continue
            known = np.array([ids[w] for w in words], dtype=np.uint64)
            found = set()
            for t, start, stop in index.candidates(gram_hashes(known, GRAM)):
                matched, first, end = align(index.ids[t], known, start, stop)
                if matched >= coverage * len(index.ids[t]):
                    found.add((t, matched, first, end))
            if found:
                places = [m.span() for m in _WORD.finditer(low)]
            for t, matched, first, end in outermost(sorted(found), [len(x) for x in index.ids], len(words)):
                begin, over = places[first][0], places[end - 1][1]
                chars = len(text[:begin].decode("utf-8", "replace"))
                out.add(
                    who, index.names[t], matched, round(matched / len(index.ids[t]), 6), first, end,
                    chars, chars + len(text[begin:over].decode("utf-8", "replace")),
                )
            if out.full():
                yield out.take()
        yield out.take()

    schema = (
        "doc_id long, license string, matched_words int, coverage double, word_from int, word_to int, char_from int, char_to int"
    )
    return map_batches(texts(docs, id_col, text_col), run, schema)
