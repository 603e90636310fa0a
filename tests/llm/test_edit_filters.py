"""Filters before the edit distance of op1 reject nothing that is within the edits; pairs vote as the walks do."""

import random

import numpy as np

from vitalstrand.llm import decontaminate as dc


def test_filters_keep_every_match():
    rng = random.Random(3)
    for _ in range(3000):
        pattern = "".join(rng.choices("abcd ", k=rng.randint(1, 40)))
        d = int(0.2 * len(pattern))
        part = list(pattern)
        for _ in range(rng.randint(0, d + 2)):
            at = rng.randint(0, len(part))
            part[at : at + rng.randint(0, 1)] = rng.choices("abcd ", k=rng.randint(0, 1))
        window = "".join(rng.choices("abcd ", k=rng.randint(0, 30))) + "".join(part) + "".join(rng.choices("abcd ", k=rng.randint(0, 30)))
        distance, end = dc.edit_distance_within(pattern, window)
        if distance <= d:
            assert dc.may_hold(window, pattern, d) and dc.may_begin(window, pattern, d)
            assert dc.edit_distance_within(pattern, window, d) == (distance, end)
        else:
            assert dc.edit_distance_within(pattern, window, d)[0] > d


def test_ends_agree_with_walks_step_by_step():
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 2**63, 200).astype(np.uint64)
    n = len(hashes) - dc.STEPS
    ends = dc.walk_ends(hashes, n)
    for table in range(dc.TABLES[-1]):
        for start in range(n):
            at = start
            for step in range(dc.STEPS - 1):
                at += (int(hashes[at]) >> 32 + dc.STEPS * (table // 2) + step & 1) ^ (table % 2)
            assert [bool(ends[gap][start] >> table & 1) for gap in (1, 2)] == [at == start + 1, at == start + 2]


def test_words_are_the_tokens_of_each_text():
    rng = random.Random(5)
    signs = ["a", "B", "\u00e9", "\u0130", "\u03a3", "\U0001d538", "\U0001f600", " ", "\n", "\u3000", ".", "_", "9", "\u4e2d", "\u00df", "\x1c"]
    texts = [None, "", " ", "...", *("".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(500))]
    words = dc.Words(texts)
    for k, text in enumerate(texts):
        want = [t.replace("\u0307", "") for t in dc.tokens(text)]
        span = slice(words.until[k], words.until[k + 1])
        assert words.text(k) == " ".join(["", *want, ""]) or not want and words.text(k) == " "
        assert words.begins[span].tolist() == [1 + sum(len(t) + 1 for t in want[:i]) for i in range(len(want))]
        assert words.hashes[span].tolist() == [int(dc.Words([t]).hashes[0]) for t in want]


def test_begins_are_told_one_by_one():
    # both halves are there, but further apart than the edits allow
    left, right = "abcdefghijkl", "mnopqrstuvwx"
    window = left + "0" * 9 + right
    assert dc.may_hold(window, left + right, 4) and not dc.may_begin(window, left + right, 3)
    assert dc.may_begin(left + "000" + right, left + right, 3)
