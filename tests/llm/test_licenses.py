"""Licence scans: the alignment against a plain table of cells, whole licences, matches inside longer ones."""

import random

import numpy as np

from hydroseries.llm import licenses


def plain(template, text, low, high):
    """Smith-Waterman cell by cell within the band: match 2, change -1, gap -1."""
    band = 3 + len(template) // 8
    cells, best, best_end = {}, (0, 0, -1), -1
    for i, word in enumerate(template):
        for j in range(max(0, low - band + i), min(len(text), high + band + i + 1)):
            s, m, first = cells.get((i - 1, j - 1), (0, 0, -1))
            cell = (s + 2, m + 1, j if first < 0 else first) if word == text[j] else (s - 1, m, first)
            for s, m, first in (cells.get((i - 1, j), (0, 0, -1)), cells.get((i, j - 1), (0, 0, -1))):
                if s - 1 > cell[0]:
                    cell = (s - 1, m, first)
            if cell[0] > 0:
                cells[i, j] = cell
                if cell[0] > best[0]:
                    best, best_end = cell, j + 1
    return best[1], best[2], best_end


def test_alignment_equals_the_plain_table():
    rng = random.Random(5)
    for _ in range(400):
        template = [rng.randrange(5) for _ in range(rng.randint(3, 40))]
        text = [rng.randrange(5) for _ in range(rng.randint(0, 50))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(text))
            text[at:at] = [w if rng.random() < 0.9 else 9 for w in template if rng.random() < 0.9]
        low = rng.randint(-5, len(text))
        high = low + rng.randint(0, 6)
        got = licenses.align(np.array(template, dtype=np.uint64), np.array(text, dtype=np.uint64), low, high)
        want = plain(template, text, low, high)
        assert got[0] == want[0] and (not want[0] or got == want), (template, text, low, high)


def test_every_template_is_found_as_itself(spark):
    rng = random.Random(2)
    names = sorted(licenses.TEMPLATES)
    docs = []
    for i, name in enumerate(names):
        docs.append((i, f"Some words of our own. {licenses.TEMPLATES[name]} And more of them."))
        words = licenses.TEMPLATES[name].split()
        if len(words) > 60:
            docs.append((100 + i, "before " + " ".join(w if rng.random() < 0.95 else "other" for w in words) + " after"))
    docs.append((900, "you may obtain a copy of the book, without warranty of any kind, subject to the following conditions " * 50))
    got = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, _ in docs:
        if i == 900:
            assert i not in by
            continue
        main = max(by[i], key=lambda r: r["matched_words"])
        assert main["license"] == names[i % 100], (names[i % 100], [(r["license"], r["coverage"]) for r in by[i]])
        assert main["coverage"] == 1 if i < 100 else 0.85 < main["coverage"] < 1
        assert len(by[i]) == 1, (names[i % 100], [(r["license"], r["word_from"], r["word_to"]) for r in by[i]])
    families = {n.split("/")[0] for n in names if n.endswith("/text")}
    assert families >= {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"}


def test_matches_in_longer_ones():
    inside = [(0, 10, 5, 15), (1, 40, 0, 41), (2, 3, 41, 44), (2, 3, 41, 44)]
    assert licenses.outermost(inside, [10, 40, 3], 50) == [(1, 40, 0, 41), (2, 3, 41, 44)]
    assert licenses.outermost([(0, 30, 0, 30), (1, 30, 0, 30)], [30, 36], 40) == [(0, 30, 0, 30)]
