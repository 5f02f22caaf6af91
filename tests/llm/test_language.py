"""Language identification: held-out accuracy, spans of mixed texts, Viterbi against all paths, odd rows."""

import itertools
import random
import zlib

import numpy as np
import pytest

from cohortlab.llm import language

SYLLABLES = {
    "aa": "tion ing the er and st re".split(),
    "bb": "sch ung en der ein keit zu".split(),
    "cc": "ный ста при ова ени ция".split(),
    "dd": "ого ще ії ють від зна".split(),
}


def words(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus():
    rng = random.Random(2)
    return [(i, words(rng, lang, rng.randint(5, 60)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=500))]


def out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    return language.fit(docs, fit_documents=100, grams_per_language=500)


def test_scripts_narrow_the_candidates(model):
    assert model.languages == ["aa", "bb", "cc", "dd"]
    assert {s: able.tolist() for s, able in model.scripts.items()} == {"Latin": [True, True, False, False], "Cyrillic": [False, False, True, True]}
    table = model.scores([("the", "Latin"), ("ного", "Cyrillic"), ("λογος", "Greek")])
    assert table[0, 2] == table[0, 3] == table[1, 0] == -language.WORD_LIMIT and not table[2].any()


def test_held_out_accuracy_and_odd_rows(spark, model):
    odd = [(None, "the ing", None), (900, None, "aa"), (901, "", "aa"), (902, "12 -- 34 ²", "bb"), (903, "λόγος", None), (904, words(random.Random(4), "bb", 20_000), None)]
    data = [(i, t, lang, 1) for i, t, lang in corpus() + odd + corpus()[:3]]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score int").repartition(3)
    got = language.identify(docs, model).collect()
    assert len(got) == len(data) and all(r.held_out == out(r.doc_id) for r in got)
    by_id = {r.doc_id: r for r in got}
    right = [by_id[i].lang_pred == lang for i, _, lang in corpus() if out(i)]
    assert len(right) > 60 and sum(right) >= 0.97 * len(right)
    assert all(0 <= r.score <= 1 for r in got)
    for i in (900, 901, 902):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].spans) == ("und", 0.0, [])
    assert by_id[903].lang_pred in model.languages and by_id[904].lang_pred == "bb" and by_id[904].score > 0.9
    assert language.identify(docs.limit(0), model).count() == 0
    empty = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}


def test_prediction_does_not_read_the_label(spark, model):
    rows = [(i, t, "aa") for i, t, _ in corpus()]
    a = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model)
    b = language.identify(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"), model)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_spans_of_a_mixed_text(spark, model):
    rng = random.Random(9)
    parts = [("aa", words(rng, "aa", 30)), ("bb", words(rng, "bb", 30)), ("cc", words(rng, "cc", 12)), ("aa", words(rng, "aa", 25))]
    text = "1, " + " 7 ".join(t for _, t in parts) + "!"
    (row,) = language.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert row.lang_pred == "aa" and [s.lang for s in row.spans] == [lang for lang, _ in parts]
    for span, (_, part) in zip(row.spans, parts):
        overlap = min(span.end, text.index(part) + len(part)) - max(span.start, text.index(part))
        assert overlap >= 0.9 * max(len(part), span.end - span.start)
    glued = words(rng, "aa", 1) + "при" * 3
    (row,) = language.identify(spark.createDataFrame([(1, " ".join([glued] * 4))], "doc_id long, text string"), model).collect()
    assert all(0 <= s.start < s.end <= len(" ".join([glued] * 4)) for s in row.spans)


def test_viterbi_equals_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 6, 1, 5])
    table = rng.normal(size=(9, 3))
    codes = rng.integers(0, 9, sizes.sum())
    prior, switch = rng.normal(size=3), 0.7
    label = language.viterbi(codes, sizes, table, prior, switch)
    at = 0
    for n in sizes.tolist():
        mine = codes[at : at + n]

        def value(path):
            return prior[path[0]] + sum(table[c, k] for c, k in zip(mine, path)) - switch * sum(a != b for a, b in zip(path, path[1:]))

        if n:
            best = max(itertools.product(range(3), repeat=n), key=value)
            assert value(tuple(label[at : at + n])) == pytest.approx(value(best))
        at += n


def test_steady_texts_are_those_of_one_language():
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 9, 400)
    table = np.minimum(rng.normal(size=(30, 3)) * 2, 0).astype(np.float32)
    table -= table.max(axis=1, keepdims=True)
    codes = rng.integers(0, 30, sizes.sum())
    prior = np.log(np.array([0.7, 0.2, 0.1]))
    one = language.steady(codes, sizes, table, prior, 6.0)
    assert 20 < (one >= 0).sum() < 380
    assert (language.best_languages(codes, sizes, table, prior, 6.0) == language.viterbi(codes, sizes, table, prior, 6.0)).all()
