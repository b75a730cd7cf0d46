"""One row per group of near copies, whatever its ids."""

import corpus_pipeline
from tests.llm.fixtures import prose


def test_one_row_of_a_group_goes_on(spark):
    a, b, c, d = (prose(80 + k, 200) for k in range(4))
    near = " ".join([*a.split()[:90], "changed", *a.split()[91:]])
    rows = [(1, a), (1, a), (2, near), (None, a), (None, b), (None, b), (7, c), (7, d), (3, d), (9, None), (9, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.keep_one(spark, docs.repartition(3), "")
    assert got.columns == docs.columns
    want = [(1, a), (None, b), (7, c), (3, d), (9, None), (None, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_repeated_rows_go_at_the_start(spark):
    rows = [(1, prose(1, 60), "en", s, 0) for s in ("b", None, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert corpus_pipeline.clean(spark, docs, "").count() == 1
