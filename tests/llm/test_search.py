"""Ranked search against a brute-force ranking, and the parts that make it skip."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from filewarden.llm import search as S

TERM = re.compile("[0-9a-z\x80-\U0010ffff]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    found = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_words = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in found:
            m = 10 + 90 * sum(c.values()) * n_docs // n_words
            score = 0
            for t in dict.fromkeys(terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, k, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, **settings):
    d = spark.createDataFrame([(i, t, "own", 1) for i, t in docs], "doc_id bigint, text string, score string, item bigint").repartition(5)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, rank int")
    return sorted(map(tuple, S.search(d, q, **settings).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    words = [f"w{int(r.paretovariate(0.6)) % 300}" for _ in range(5000)] + ["Éé", "ſ", "K", "x1"]
    docs = [(i, r.choice([" ", "-", "\n", "\x85"]).join(r.choices(words, k=r.randint(1, 80)))) for i in range(400)]
    hot = "The HOT passage w1 w2 w3 w290 Éé"
    docs += [(1000 + i, hot) for i in range(150)]  # a group of copies
    docs += [(2000, None), (2001, ""), (2002, " ,.- "), (2003, "w1 " * 30_000), (None, hot), (None, "w5 w6"), (7, docs[7][1]), (7, "w8")]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 40)))) for i in range(25)]
    items += [(100, hot), (101, ""), (102, None), (103, "unknown"), (3, "w1 w1 W1"), (None, "w290, éé")]
    return docs, items


@pytest.mark.parametrize("sizes", [(16_384, 4_000_000, 2000), (40, 500, 7)])
def test_ranking_equals_brute_force(spark, corpus, sizes):
    docs, items = corpus
    got = run(spark, docs, items, most_docs=sizes[0], most_words=sizes[1], block=sizes[2])
    assert got == brute(docs, items)


def test_empty_tables(spark, corpus):
    docs, items = corpus
    assert run(spark, [], items[:2]) == [] and run(spark, docs[:2], []) == [] and run(spark, [(1, None)], items[:2]) == []


def test_pair_bounds_are_tighter_than_single_maxima():
    own, joint = [50, 40, 30, 20], [55, 0, 25]  # no document has the second and third, few have the others
    rest = S.rest_bounds(own, joint)
    assert rest[0] == 55 + 30 and rest[1] == 40 + 20 and rest[2] == 30 and rest[3:] == [20, 0]
    assert all(b <= sum(own[i:]) for i, b in enumerate(rest[:-1]))


def test_bounds_hold_for_all_documents():
    r = random.Random(1)
    for _ in range(200):
        impacts = [[r.choice([0, 0, r.randint(1, 30)]) for _ in range(5)] for _ in range(6)]
        own = [max(d[t] for d in impacts) for t in range(5)]
        joint = [max([d[t] + d[t + 1] for d in impacts if d[t] and d[t + 1]], default=0) for t in range(4)]
        rest = S.rest_bounds(own, joint)
        assert all(sum(d[i:]) <= rest[i] for d in impacts for i in range(5))


def test_lists_behind_the_threshold_open_no_document():
    items = S.Items(["a b c"])
    batch = S._segment([1, 2, 3], [1, 1, 3], [np.array([0]), np.array([2]), np.array([0, 1, 2])])
    items.order(np.array([900, 500, 100]))
    segment = S.Segment(batch.to_pylist()[0], items, 3, 5)
    joint = [segment.pair_list(*p)[1] for p in items.pairs]
    every = S.max_score(segment, items.terms[0], joint, 1)
    assert every[0].tolist() == [0, 1, 2]
    least = int(every[1][0])
    docs, sums = S.max_score(segment, items.terms[0], joint, least)
    assert docs.tolist() == [0, 2] and sums.tolist() == [least, int(every[1][2])]
