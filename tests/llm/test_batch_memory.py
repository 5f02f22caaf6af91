import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd

from cohortlab.llm import minhash, quality


def _peak(fn, *args):
    fn(*args)  # what is remembered between calls is there already
    tracemalloc.start()
    out = fn(*args)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak / 1e6


def test_term_counts_hold_a_number_for_each_term():
    rng = random.Random(5)
    words = [f"Word{i}" for i in range(2_000)]
    texts = [" ".join(rng.sample(words, 400)) + " !! the" for _ in range(600)] + ["", " \t"]
    pdf = pd.DataFrame({"text": texts, "toxic": [i % 2 for i in range(602)], "half": [i // 2 % 2 for i in range(602)]})
    out, peak = _peak(quality._term_counts, pdf)
    want = Counter((t, y, h) for x, y, h in pdf.itertuples(index=False) for t in ("", *quality._terms(x.split())))
    assert {(t, y, h): n for t, y, h, n in out.itertuples(index=False)} == want
    assert len(out) == len(want)
    assert peak < 6  # a row for each text and term took 56 MB


def test_no_texts_have_no_terms():
    assert quality._term_counts(pd.DataFrame({"text": [], "toxic": [], "half": []})) is None


def test_sketches_hold_the_rounds_of_a_part_of_the_sets():
    rng = np.random.default_rng(5)
    sizes = [*rng.integers(1, 900, 1_500).tolist(), minhash.PIECE + 3, 1, 2]
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in sizes]
    out, peak = _peak(minhash.sketch, sets, 16)
    assert (out == np.vstack([minhash._sketches([s], 16) for s in sets])).all()
    assert minhash.sketch([], 16).shape == (0, 16)
    assert peak < 20  # all sets at once took 38 MB
