"""Benchmark passages behind characters above U+FFFF, and partial passages."""

import random

import numpy as np
import pytest

from cohortlab.llm import decontaminate as D


def find(texts, items):
    index = D.GramIndex(list(enumerate(items)), D.LeakParams())
    return D._find(index, index.lookup_table(), list(range(len(texts))), [D.normalized(t) for t in texts])


def prose(seed, n):
    rng = random.Random(seed)
    text = ""
    while len(text) < n + 1:
        text += "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) + " "
    return text[:n].strip().ljust(n, "q")


@pytest.mark.parametrize("before", ["\U0001f600" * 50, "\U0001f600 " * 300, "é\U00020000" * 40, "\ud800" * 30])
def test_passages_behind_characters_above_the_basic_plane(before):
    item = prose(1, 220)
    copy = item[:70] + "z" + item[71:150] + item[151:]
    for passage in (item, copy, item.replace(" ", " \U0001f600", 1)):
        text = f"{before} {passage} {prose(2, 300)}"
        ((doc, found, *_, start, end),) = find([prose(3, 500), text], [prose(4, 150), item])
        assert (doc, found) == (1, 1)
        assert abs(start - len(before.strip()) - 1) <= 12 and abs(end - start - len(passage)) <= 12


def test_partial_passages_wherever_they_start():
    for n, at in ((81, 7), (100, 50), (233, 91), (394, 333)):
        item = prose(n, n)
        parts = [item[a : a + 50] for a in sorted({*range(0, n - 49, 3), n - 50, min(at, n - 50)})]
        texts = [f"{prose(5, 80)} {p} {prose(6, 80)}" for p in parts] + parts
        assert {r[0] for r in find(texts, [item])} == set(range(len(texts))), n


def test_copies_with_replaced_words():
    short, long = prose(7, 81), prose(8, 233)
    for old in (short[36:42], short[0:8], short[73:81]):
        text = f"{prose(9, 120)} {short.replace(old, '#' * len(old))} {prose(10, 90)}"
        assert [r[0] for r in find([text], [short])] == [0], old
    text = prose(9, 120) + long[:72] + "########" + long[80:147] + "########" + long[155:] + prose(10, 90)
    assert [r[0] for r in find([text], [long])] == [0]


def test_every_segment_has_a_bound_that_filters():
    index = D.GramIndex([(n, prose(n, n)) for n in (12, 15, 20, 33, 50, 51, 81, 100, 101, 394)], D.LeakParams())
    assert index.bound.min() >= 1
    assert all(len(t) - 7 - 8 * k == b for t, k, b in zip(index.texts, index.budget, index.bound, strict=True))


def test_regions_with_a_copy_within_its_budget_are_never_dropped_before_the_alignment():
    rng = random.Random(11)
    items = [prose(n, n) for n in (12, 33, 50, 100, 233)]
    index = D.GramIndex(list(enumerate(items)), D.LeakParams())
    segments, regions = [], []
    for o, text in enumerate(index.texts):
        copy = list(text)
        for _ in range(int(index.budget[o])):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randint(0, 1)] = rng.choice(["", "#", "\U0001f600"])
        segments.append(o)
        regions.append(prose(o, 15) + "".join(copy) + prose(o + 1, 15))
    cells = D._cells(D._units("".join(regions)))
    high = np.cumsum([len(r) for r in regions])
    low = high - [len(r) for r in regions]
    assert D._hold(index, np.array(segments), cells, low, high).all()
    other = np.roll(np.array(segments), 1)
    apart = index.cell_at[other] - index.cell_at
    assert not D._hold(index, other, cells, low, high)[np.abs(apart) > 120].any()
