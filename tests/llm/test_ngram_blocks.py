"""Blocks of the n-gram scores stay bounded when one row is repeated."""

from cohortlab.llm import ngram_lm


def test_repeated_rows_are_dealt_over_the_blocks(spark):
    rows = [(None, "one row repeated all over")] * 400 + [(7, "another row that is repeated")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes = [r["count"] for r in ngram_lm.deal(docs, 20).groupBy("block").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 3 * 800 / 20
    got = ngram_lm.score(docs, ngram_lm.LmParams(block_chars=1000)).collect()
    whole = ngram_lm.score(docs).collect()
    assert len(got) == len(whole) == 800
    assert {(r["doc_id"], r["n_tokens"], round(r["log_score"], 9)) for r in got} == {(r["doc_id"], r["n_tokens"], round(r["log_score"], 9)) for r in whole}
