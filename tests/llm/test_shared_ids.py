"""Near copies of rows that share an id but not a text."""

from filewarden.llm.ngrams import near_copies, packed_sets
from tests.llm.fixtures import prose


def edited(text, place):
    w = text.split()
    w[place] = "changed"
    return " ".join(w)


def test_sets_with_the_same_smallest_id_keep_their_links(spark):
    texts = [prose(70 + k, 200) for k in range(4)]
    rows = [(1, t) for t in texts] + [(10 + k, edited(t, 90)) for k, t in enumerate(texts)] + [(20, texts[0])]
    for parts in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        got = near_copies(docs).collect()
        assert len(got) == len(rows)
        assert {r["component_id"] for r in got} == {1}


def test_signatures_in_slices_grow_with_shingles_not_with_slices(spark):
    rows = [(k, prose(k % 40, 120)) for k in range(120)] + [(None, prose(3, 120))] * 5
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    for slices in (1, 16, 256):
        sent = packed_sets(docs, slices, 3)
        sizes = sent.selectExpr("sum(length(signs))", "sum(length(docs)) / 2", "max(length(signs))").first()
        shingles = 40 * 118
        assert sizes[1] == shingles  # equal sets of a chunk travel once
        assert sizes[0] <= min(8 * shingles, slices * 40 * 8)
        assert sizes[2] <= 40 * 8
