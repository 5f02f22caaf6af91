"""Periodic runs against brute force; nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import random
import zlib
from fractions import Fraction

import pytest

from cohortlab.llm import runs
from cohortlab.llm.common import column
from cohortlab.llm.queries import op11_periodic_runs


def brute_runs(words, least_length=6, least_exponent=4):
    """Every (start, length, period): maximal stretches for each period, the smallest period of each stretch."""
    n, best = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                best.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in best.items() if e - s >= max(least_length, least_exponent * q))


def brute_tail(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute_row(words):
    found = brute_runs(words)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    strongest = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return len(words), found, strongest, " ".join(w for k, w in enumerate(words) if k not in gone)


def random_words(rng):
    kind = rng.randrange(4)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(60))]
    if kind == 1:
        return [rng.choice("abcdef") for _ in range(rng.randrange(40))]
    if kind == 2:
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        return [rng.choice("abx") for _ in range(rng.randrange(8))] + unit * rng.randint(1, 9) + unit[: rng.randrange(len(unit))] + [rng.choice("aby") for _ in range(rng.randrange(8))]
    a, b = ["a"], ["a", "b"]  # Fibonacci words hold many runs
    for _ in range(rng.randint(2, 8)):
        a, b = b, b + a
    return b


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (1, 3)])
def test_runs_equal_brute_force(least):
    rng = random.Random(5)
    texts = [random_words(rng) for _ in range(400)]
    row, start, length, period, repeated = runs.runs_of([[w.encode() for w in t] for t in texts], *least)
    found = {}
    for r, *run in zip(row.tolist(), start.tolist(), length.tolist(), period.tolist()):
        found.setdefault(r, []).append(tuple(run))
    flags = repeated.tolist()
    for r, words in enumerate(texts):
        expected = brute_runs(words, *least)
        assert found.get(r, []) == expected, words
        mine, flags = flags[: len(words)], flags[len(words) :]
        assert mine == [any(s + q <= k < s + n for s, n, q in expected) for k in range(len(words))]


def test_small_cells_give_the_same(monkeypatch):
    rng = random.Random(6)
    texts = [[w.encode() for w in random_words(rng)] for _ in range(80)]
    whole = [x.tolist() for x in runs.runs_of(texts, 2, 2)]
    monkeypatch.setattr(runs, "CELLS", 37)
    assert [x.tolist() for x in runs.runs_of(texts, 2, 2)] == whole


def test_one_word_many_times():
    n = 200_000
    row, start, length, period, repeated = runs.runs_of([[b"a"] * n], 6, 4)
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [n], [1]) and repeated.sum() == n - 1


def test_find_runs_on_odd_rows(spark, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(random_words(rng)) for _ in range(60)]
    texts += [None, "", " \t\n", "one", "Ab ab " * 5, "é x é x " * 4, "q\x0br\x0cs " * 6, "z " * 5_000, *["la li lu " * 6] * 3]
    data = [(i if i % 9 else None, t, "r", 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, runs string, `a.b` int, n_words int").repartition(3)
    found = runs.find_runs(docs).collect()

    def plain(r):
        return tuple(r) if r else None

    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], plain(r.strongest), r.collapsed) for r in found), key=str)
    words = [(i, (t or "").encode().split()) for i, t, *_ in data]
    want = sorted(((i, *brute_row([w.decode() for w in ws])) for i, ws in words), key=str)
    assert got == want
    assert runs.find_runs(docs.limit(0)).count() == 0


def test_periodic_tail_and_query(spark, tmp_path):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(70))) for i in range(300)}
    rows = [*texts.items(), (None, "x y z"), (10**15, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tails = docs.select("doc_id", runs.periodic_tail(column("text"), column("doc_id")).alias("text")).collect()
    planted = {r.doc_id: r.text for r in tails}
    assert planted[None] == "x y z" and planted[10**15] is None
    for i, t in texts.items():
        assert planted[i].split() == brute_tail(t.split(), i)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    import hashlib

    got = {r.doc_id: r for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in texts.items():
        n, found, strongest, collapsed = brute_row(brute_tail(t.split(), i))
        r = got[i]
        s, length, q = strongest or (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), s, length, q, strongest and 1000 * length // q)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed.encode()).hexdigest()
    assert sum(r.n_runs > 0 for r in got.values()) > 10
