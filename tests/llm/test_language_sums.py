"""Sums over all segmentations, with pieces and words of any length, against brute force."""

import math
from collections import Counter

import numpy as np
import pytest

from linkatlas.llm import language, queries
from linkatlas.llm.wordgrid import Letters, WordGrid

PIECES = ["▁", "a", "b", "ab", "ba", "▁a", "abababababab", "bab", "▁ababababababababab", "c"]
WORDS = {"ab": 3.0, "abababababababab": 2.0, "b": 1.0, "abxba": 4.0, "c" * 45: 1.5, "ab" * 30: 0.5, "é": 1.0}


def segmentations(word, pieces):
    """Every way to cut the word, as lists of piece numbers."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        head = word[:n]
        if head in pieces or n == 1:
            for rest in segmentations(word[n:], pieces):
                yield [pieces.index(head) if head in pieces else len(pieces), *rest]


def by_recursion(word, pieces, probs):
    """Sum and expected counts by a plain recursion over places, in whole precision."""
    n = len(word)
    steps = [[(i, pieces.index(word[i:j]) if word[i:j] in pieces else len(pieces)) for i in range(j) if word[i:j] in pieces or j - i == 1] for j in range(n + 1)]
    alpha, beta = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for j in range(1, n + 1):
        alpha[j] = math.fsum(alpha[i] * probs[p] for i, p in steps[j])
    for j in range(n, 0, -1):
        for i, p in steps[j]:
            beta[i] += probs[p] * beta[j]
    counts = np.zeros(len(pieces) + 1)
    for j in range(1, n + 1):
        for i, p in steps[j]:
            counts[p] += alpha[i] * probs[p] * beta[j] / alpha[n]
    return alpha[n], counts


@pytest.fixture
def probs():
    draw = np.random.default_rng(3)
    return draw.dirichlet(np.ones(len(PIECES) + 1), 2).T


def test_recursion_is_the_sum_over_segmentations(probs):
    for word in ("▁ab", "▁abab", "▁babé"):
        ways = list(segmentations(word, PIECES))
        each = [math.prod(probs[p, 0] for p in way) for way in ways]
        total, counts = by_recursion(word, PIECES, probs[:, 0])
        assert total == pytest.approx(sum(each))
        want = Counter()
        for way, p in zip(ways, each):
            for piece in way:
                want[piece] += p / sum(each)
        assert counts == pytest.approx([want[i] for i in range(len(PIECES) + 1)])


@pytest.mark.parametrize("longest", [32, 3, 100])
def test_sums_of_words_of_any_length(probs, monkeypatch, longest):
    monkeypatch.setattr(language, "LONGEST_RUN", longest)
    model = language.Model(["x", "y"], PIECES, probs)
    for word in WORDS:
        totals = [by_recursion("▁" + word, PIECES, probs[:, k])[0] for k in range(2)]
        lang, score = model.judge([word])
        assert score[0] == pytest.approx(max(totals) / sum(totals)) and lang == ["xy"[int(np.argmax(totals))]]
    text = " ".join(WORDS)
    logs = [sum(math.log(by_recursion("▁" + w, PIECES, probs[:, k])[0]) for w in WORDS) for k in range(2)]
    assert model.judge([text])[1][0] == pytest.approx(1 / (1 + math.exp(-abs(logs[0] - logs[1]))))


def test_expected_counts(probs):
    finder = language.Pieces(PIECES)
    assert finder.longest == 19
    want = sum(w * by_recursion("▁" + word, PIECES, probs[:, 0])[1] for word, w in WORDS.items())
    grid = WordGrid(list(WORDS), Letters(False))
    weights = np.array(list(WORDS.values()))
    short = grid.only(grid.length <= 32)
    chars, lengths, row = language.word_rows(short)
    got = language.expected_counts(language.lattice(chars, lengths, finder), lengths, np.bincount(row, weights[short.doc], len(lengths)), probs[:, [0]], len(PIECES))
    for i in np.flatnonzero(grid.length > 32):
        got += language.long_expected_counts(language._marked(grid, i), finder, probs[:, [0]], weights[grid.doc[i]])
    assert got == pytest.approx(want)


def test_all_pieces_are_kept():
    pieces = language.vocabulary_pieces(queries.PIECE_VOCABULARY)
    assert max(map(len, pieces)) > 10 and "▁information" in pieces


def test_very_long_words_keep_their_sums():
    probs = np.full((len(PIECES) + 1, 1), 0.01)
    word = np.array([ord(c) for c in "▁" + "ab" * 50_000], np.uint64)
    total = language.long_log_sums(word, language.Pieces(PIECES), probs)
    assert np.isfinite(total).all() and total[0] < -1000
