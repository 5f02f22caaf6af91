"""Class counts of a batch of texts hold few arrays at once."""

import tracemalloc

import numpy as np

from cohortlab.llm import secrets as S


def test_counts_in_pieces_are_those_of_the_whole(monkeypatch):
    texts = ["Key=AKIA09+/", "", "é", "x" * 40, "0123456789abcdef " * 5]
    data = np.frombuffer(("\n\n" + "\n".join(texts) + "\n").encode(), np.uint8)
    c = S.BYTE_CLASS[data].astype(np.int64)
    whole = np.bincount((c[:-2] * S.WIDTH + c[1:-1]) * S.WIDTH + c[2:], minlength=S.WIDTH**3)
    for piece in (1, 7, len(data) - 2, 1 << 18):
        monkeypatch.setattr(S, "PIECE", piece)
        assert (S.class_counts(texts) == whole).all()


def test_a_batch_of_long_texts_needs_little_memory():
    texts = ["token = 0a9F and words " * 400] * 500
    size = sum(map(len, texts))
    tracemalloc.start()
    S.class_counts(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * size + 16_000_000
