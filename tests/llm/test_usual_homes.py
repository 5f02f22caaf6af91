"""Groups whose members meet in another home are no work of their own pivot; components need no table of distinct edges."""

from cohortlab.llm import components, minhash

ROW = "a long, b long, n_a long, n long, home long, label long, size long"


def test_members_of_one_home_are_not_dealt_again(spark):
    usual = [(1, b, 60, 60, 900, b, 102) for b in range(100, 200)]
    rare = [(1, 200, 60, 60, 1, 200, 102), (1, 201, 60, 60, 901, 201, 102)]
    own = [(2, b, 60, 60, 2, b, 80) for b in range(300, 380)]
    left = minhash._usual(spark.createDataFrame(usual + rare + own, ROW))
    assert {r.rare for r in left.where("a = 1").collect()} == {2}  # 102 members, yet 2 to compare
    assert {r.rare for r in left.where("a = 2").collect()} == {80}
    found = [(r.a, r.b) for r in minhash._direct(left.where("rare <= 64"), 75).collect()]
    assert len(found) == len(set(found)) == 2 * 100 + 1
    assert {frozenset(p) for p in found} == {frozenset((x, y)) for x in range(100, 202) for y in (200, 201) if x != y}
    assert all(x < y for x, y in found)


def test_components_write_no_edges(spark, monkeypatch):
    kinds = []
    inner = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, kind: kinds.append(kind) or inner(df, kind))
    edges = spark.createDataFrame([(3, 2), (3, 2), (2, 1), (7, 7), (8, 9), (9, 8)], "a long, b long")
    found = {r.node: r.label for r in components.connected_components(edges).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} and set(kinds) == {"labels"}
