"""Regressions: repeated labels, far ids, null ids with benchmark passages, items shorter than a segment with edits."""

import hashlib
import random

from cohortlab.llm import decontaminate, quality, spotsigs

rng = random.Random(4)
WORDS = ["the", "of", "and"] + ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(200)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_repeated_labels_give_one_result_in_any_row_order(spark):
    docs = [(i, prose(30)) for i in range(40)] + [(3, prose(30)), (3, prose(10))]
    labels = [(i, y, 1 - y) for i in range(40) for y in (0, 1)] + [(5, 1, 0), (6, 0, 1), (None, 1, 0)]
    results = []
    for order in range(3):
        shuffled = labels[:]
        random.Random(order).shuffle(shuffled)
        d = spark.createDataFrame(random.Random(order).sample(docs, len(docs)), "doc_id long, text string").selectExpr("*", "'s' as source", "'en' as lang").repartition(order + 1)
        found = quality.classify(d, spark.createDataFrame(shuffled, "doc_id long, quality int, toxic int").repartition(2 - order % 2))
        results.append(sorted((r.doc_id, round(r.quality_posterior, 9), round(r.toxic_posterior, 9), r.rejected) for r in found.collect()))
    assert results[0] == results[1] == results[2] and len(results[0]) == len(docs)


def test_far_and_uneven_ids_have_their_successors(spark):
    ids = [-(2**63), 2**63 - 1, 0, 1, 2, 3, 10**17, None, None, *(rng.randint(-(2**62), 2**62) for _ in range(300)), *[7] * 5]
    rows = [(i, prose(rng.randint(0, 20))) for i in ids]
    params = spotsigs.SpotParams(slice_rows=3)
    got = spotsigs.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), params)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        cut, following = len(t) // 4, order[(k + 1) % len(order)][1]
        want.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got.collect()), key=str) == sorted(want, key=str)
    slices = spotsigs.with_next(spark.createDataFrame([(i, "x") for i in range(2000)] + [(10**18, "y")], "doc_id long, text string"), spotsigs.SpotParams(slice_rows=100))
    assert slices.count() == 2001


def test_rows_without_an_id_are_searched_and_cleaned(spark):
    item = prose(40)
    rows = [(None, prose(10) + " " + item + " " + prose(5)), (1, item), (1, prose(30)), (2, prose(30)), (None, prose(30)), (None, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()} == {(None, 9), (1, 9)}
    kept = {(r.doc_id, r.text) for r in decontaminate.clean(docs, benchmark).collect()}
    assert kept == set(rows[2:])


def test_an_item_of_seventy_characters_is_found_with_seven_edits(spark):
    item = "abcdefgh ijklmnop qrstuvwx yzabcdeg hijklmno pqrstuvw xyzacdef ghijkl"
    assert 60 <= len(item) < 80
    places = [5 + 10 * k for k in range(6)]
    edited = "".join("#" if i in places else c for i, c in enumerate(item))
    docs = spark.createDataFrame([(1, prose(20) + " " + edited + " " + prose(20)), (2, prose(60))], "doc_id long, text string")
    found = decontaminate.leaks(docs, spark.createDataFrame([(4, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 4)]
