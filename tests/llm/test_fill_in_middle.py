"""Fill-in-middle against a row-by-row version and an exact round trip; odd rows."""

import hashlib
import random
import re

from cohortlab.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, seed=42, rate=50, spm_rate=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    rng = random.Random(3)
    alphabet = ["a", "bc", "é", "漢字", "😀", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", " ", "<", "P", ">", "S>", "<M"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(600)]
    return [*out, None, "", " ", "\n\n", "x", "a <P> b", "<S>", "<M>", "<", "P>", "<P", ">", "😀" * 30, "word " * 30_000, *["same text here"] * 3]


def test_outputs_and_round_trip(spark, monkeypatch):
    data = [(i if i % 50 else None, t, "f", 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(data, "doc_id long, text string, form string, `a.b` int").repartition(3)
    for options in ({}, {"rate": 100}, {"rate": 100, "spm_rate": 0, "seed": 7}):
        cut = fim.transform(docs, **options)
        got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in fim.restore(cut).collect()), key=str)
        want = sorted(((i, *brute(i, t, **options), t or "") for i, t, *_ in data), key=str)
        assert got == want
    assert {r[2] for r in want} == {"plain", "psm"}
    assert fim.restore(fim.transform(docs.limit(0))).count() == 0


def test_slices_carry_the_shift(monkeypatch):
    import numpy as np

    monkeypatch.setattr(fim, "SLICE_BYTES", 5)
    places, shifts = np.array([0, 3, 3, 9, 20]), np.array([4, 1, -2, 7, 9])
    got = np.concatenate([target for _, _, target in fim.shifted(places, shifts, 18)])
    assert got.tolist() == [i + (4 if i < 3 else -2 if i < 9 else 7) for i in range(18)]


def test_broken_outputs_give_null(spark):
    rows = [("plain", "a<P>b"), ("psm", "<P>a<S>b<M>c"), ("spm", "<S>b<P>a<M>c"), ("psm", "<S>b<P>a<M>c"), ("spm", "x<S>b<P>a<M>c"),
            ("psm", "<P>a<S>b"), ("psm", ""), ("odd", "x"), (None, "x"), ("plain", None), ("psm", "<P>a<S>b<M>c<M>"), ("spm", "<S><P><M>")]
    cut = spark.createDataFrame([(k, f, o, "old") for k, (f, o) in enumerate(rows)], "k int, form string, output string, Restored string")
    got = [r.restored for r in fim.restore(cut).orderBy("k").collect()]
    assert got == ["a<P>b", "acb", "acb", None, None, None, None, None, None, None, None, ""]
