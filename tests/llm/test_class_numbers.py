"""Near-duplicate classes are numbers between their digests and their component."""

from cohortlab.llm import minhash


def test_classes_are_joined_and_grouped_as_numbers(spark, monkeypatch):
    kinds = []
    inner = minhash.connected_components

    def spied(edges):
        kinds.append(dict(edges.dtypes))
        return inner(edges)

    monkeypatch.setattr(minhash, "connected_components", spied)
    words = [f"w{i}" for i in range(60)]
    near = [*words[:-1], "other"]
    rows = [(5, " ".join(words)), (3, " ".join(words)), (4, " ".join(near)), (9, " ".join(reversed(words))), (8, None), (None, " ".join(words))]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found} == {
        (5, 56, 3, False), (3, 56, 3, True), (4, 56, 3, False), (9, 56, 9, True), (8, 0, 8, True), (None, 56, 3, False)}
    assert kinds and all(k == {"a": "bigint", "b": "bigint"} for k in kinds)
