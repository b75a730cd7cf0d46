"""The repeat rule on lines of any length."""

import random

import corpus_pipeline
from filewarden.llm.quality import quality_rules
from tests.llm.fixtures import prose


def test_clean_text_on_one_long_line_is_kept(spark):
    vocabulary, r = prose(1, 3000).split(), random.Random(2)
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    natural = " ".join(r.choices(vocabulary, weights, k=40_000))
    period = " ".join([prose(3, 150)] * 40)
    mostly = prose(4, 100) + " spam" * 900
    rows = [(0, natural), (1, natural[:3000]), (2, "spam " * 40 + "\n" + prose(5, 300)), (3, period + "\n" + prose(6, 20_000)), (4, mostly)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {x["doc_id"]: x["quality"]["n_failed_lines"] for x in quality_rules(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1}
    assert {x["doc_id"]: x["text"] == rows[x["doc_id"]][1] for x in corpus_pipeline.clean(spark, docs, "").collect()}.get(0)
