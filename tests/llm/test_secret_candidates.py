"""Learnt formats: every token from the shortest training string on is scored, dots included; ordinary text stays."""

import random

import numpy as np

from cohortlab.llm import secrets as S

rng = random.Random(5)
PROSE = "The meeting of 2024-12-03 was moved to 10.30 by the committee, see notes-final.txt and version 1.24.3 of the client. " * 30
CAMEL = "getUserName parseHttp2Request MAX_RETRIES user_id=42 www.example.org/news/2023/11/05/some-title.html "


def short():
    return "".join(rng.choice(a) for a in ("abcdef", "abcdef", "abcdef", "0123456789", "0123456789", "0123456789", "XYZ", "XYZ", "0123456789", "0123456789"))


def dotted():
    return "".join(rng.choice("abcdefghijABCDEFGHIJ0123456789") for _ in range(12)) + "." + "".join(rng.choice("abcdefghijABCDEFGHIJ0123456789") for _ in range(12))



def test_short_and_dotted_values_are_found(spark):
    rows = [(i, f"{PROSE}{CAMEL} password = {short()} and token: {dotted()} .") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = S.fit_formats(docs)
    a, b = short(), dotted()
    text = f"{PROSE}{CAMEL} see {a}, or {b}. {PROSE}"
    base, spans = S.all_spans(text, found)
    assert base == [] and [(text[x:y], k) for x, y, k, _ in spans] == [(a, "format_assign"), (b, "format_assign")]
    assert S.masked(f"key {a}.", found) == "key [SECRET]."
    plain = spark.createDataFrame([(1, PROSE + CAMEL), (2, None), (3, "")], "doc_id long, text string")
    assert [r["n_learnt"] for r in S.scan(plain, found).collect()] == [0, 0, 0]


def test_texts_without_credentials_have_no_formats(spark):
    none = S.fit_formats(spark.createDataFrame([(1, PROSE), (2, None)], "doc_id long, text string"))
    assert none.automata == {} and S.all_spans(PROSE, none) == ([], [])


def test_class_counts_against_a_plain_count():
    texts = ["ab 12", "", "Zé-x", "q"]
    want = np.zeros(S.WIDTH**3)
    data = ("\n\n" + "\n".join(texts) + "\n").encode()
    c = [S.CLASSES.index(S.as_format(chr(x))) if x < 128 and S.as_format(chr(x)) in S.CLASSES else S.OTHER for x in data]
    for x, y, z in zip(c, c[1:], c[2:]):
        want[(x * S.WIDTH + y) * S.WIDTH + z] += 1
    assert (S.class_counts(texts) == want).all()


def test_ordinary_likelihoods_sum_to_one():
    n = S.Ordinary(S.class_counts([PROSE, CAMEL]))
    assert abs(sum(2**x for x in n.first) - 1) < 1e-9
    assert all(abs(sum(2**x for x in row) - 1) < 1e-9 for block in n.next for row in block)
