"""Planted quotations with exchanged words, numbers and page matter; the search of diagonals against all alignments."""

from __future__ import annotations

import functools

import numpy as np
import pytest

from sphaera.llm import contamination

RNG = np.random.default_rng(3)
WORDS = ["w" + "".join(RNG.choice(list("abcdefgh"), 4)) for _ in range(3000)]


def planted(rng, carried: int, exchanged: int, numbers: int, matter: int, at: int | None = None) -> tuple[str, str]:
    passage = [str(w) for w in rng.choice(WORDS, 100)]
    start = int(rng.integers(0, 100 - carried))
    quote = passage[start : start + carried]
    for i in rng.choice(np.arange(1, carried - 1), exchanged, replace=False):
        quote[i] = "anders" + str(i)
    for i in sorted(rng.choice(np.arange(1, carried), numbers, replace=False).tolist(), reverse=True):
        quote.insert(i, str(rng.integers(1, 999)))
    if matter:
        i = at or int(rng.integers(6, len(quote) - 6))
        quote[i:i] = [f"{w}x" for w in rng.choice(WORDS, matter)]
    around = [[f"{w}x" for w in rng.choice(WORDS, 150)] for _ in range(2)]
    return " ".join(passage), " ".join([*around[0], "vorher", *quote, "nachher", *around[1]])


@pytest.mark.parametrize("case", [(30, 3, 0), (30, 3, 1), (30, 3, 2), (40, 3, 2), (40, 4, 2), (40, 5, 3), (40, 0, 5), (60, 4, 3)])
def test_numbers_between_words_lose_nothing(case):
    rng = np.random.default_rng(case)
    for _ in range(60):
        passage, text = planted(rng, *case, 0)
        assert contamination.PassageIndex([(1, passage)]).leaked(text) == [1]


@pytest.mark.parametrize("matter", [21, 25, 40, 100, 250])
def test_page_matter_up_to_a_page_loses_nothing(matter):
    rng = np.random.default_rng(matter)
    for _ in range(30):
        passage, text = planted(rng, 34, 0, 1, matter)
        assert contamination.PassageIndex([(1, passage)]).leaked(text) == [1]
        passage, text = planted(rng, 29, 0, 0, matter)
        assert contamination.PassageIndex([(1, passage)]).leaked(text) == []


def test_pieces_more_than_a_page_apart_are_two_quotations():
    rng = np.random.default_rng(10)
    for _ in range(20):
        passage, text = planted(rng, 34, 0, 0, 400, at=17)
        assert contamination.PassageIndex([(1, passage)]).leaked(text) == []


def test_most_quotations_with_exchanged_words_and_matter_are_found():
    rng = np.random.default_rng(9)
    found = sum(contamination.PassageIndex([(1, p)]).leaked(t) == [1] for p, t in (planted(rng, 32, 3, 2, 60) for _ in range(100)))
    assert found >= 97  # lost are those whose piece at the matter shows no three running words


def test_quotations_are_found_across_windows_of_long_texts():
    rng = np.random.default_rng(4)
    passage, text = planted(rng, 34, 2, 1, 30)
    for ahead in range(0, 2 * contamination.SPAN, 97):
        assert contamination.PassageIndex([(1, passage)]).leaked(" ".join(["davor"] * ahead + [text] + ["danach"] * 3000)) == [1]


def test_one_very_long_passage_takes_memory_by_its_words():
    rng = np.random.default_rng(5)
    passages = [(0, " ".join(map(str, rng.choice(WORDS, 20_000))))] + [(i, planted(rng, 30, 0, 0, 0)[0]) for i in range(1, 300)]
    index = contamination.PassageIndex(passages)
    assert sum(a.nbytes for a in vars(index).values() if isinstance(a, np.ndarray)) < 60 * int(index.lengths.sum())
    words = passages[0][1].split()
    assert 0 in index.leaked(" ".join(["davor"] * 40 + words[15_000:15_035] + ["danach"] * 40))


def best_runs(equal: np.ndarray, diagonal: np.ndarray) -> bool:
    """All chains by recursion from each start."""
    m = equal.shape[1]

    @functools.cache
    def best(start: int, p: int, k: int) -> int:
        """Best score of the words start..p of a chain that is on diagonal k at p."""
        gain = 1 if equal[k, p] else 1 - contamination.ONE_IN
        if p == start:
            return 0 + gain if equal[k, p] else -(10**6)
        options = [best(start, p - 1, j) for j in range(k + 1)]
        for j in range(k + 1, len(diagonal)):
            x = int(diagonal[j] - diagonal[k])
            if x < contamination.ONE_IN and p - 1 - x >= start:
                options.append(best(start, p - 1 - x, j) - x * (contamination.ONE_IN - 1))
        return max(options) + gain

    return any(equal[k, e] and best(s, e, k) >= 0 for s in range(m) for e in range(s + contamination.LEAST_WORDS - 1, m) for k in range(len(diagonal)))


def test_chains_equal_all_alignments():
    rng = np.random.default_rng(6)
    seen = set()
    for case in range(60):
        m, lines = 36, int(rng.integers(2, 5))
        diagonal = np.sort(rng.choice(np.arange(12), lines, replace=False))
        equal = np.zeros((lines, m), bool)
        line, p = int(rng.integers(lines)), 0
        while p < m:
            run = int(rng.integers(3, 20))
            equal[line, p : p + run] = rng.random(len(equal[line, p : p + run])) > 0.05
            before, line = line, int(rng.integers(lines))
            p += run + max(0, int(diagonal[before] - diagonal[line])) * int(rng.integers(2))
        want = best_runs(equal, diagonal)
        seen.add(want)
        assert contamination.chained(equal, diagonal) == want, case
    assert seen == {True, False}
