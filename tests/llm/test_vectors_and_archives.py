import hashlib
import math

import numpy as np
import pytest

from filewarden.llm.chat import escape, format_turns, parse, read_back, render, unescape
from filewarden.llm.components import components
from filewarden.llm import embeddings as E
from filewarden.llm.embeddings import near_duplicates
from filewarden.llm.warc import archive
from filewarden.session import shared_folder
from tests.llm.fixtures import smallest_reachable

VECTORS = "vec_id bigint, embedding array<float>, label int, copies string, rep string"


def brute_vectors(rows, cosine=0.93):
    ok = lambda r: r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    usable = [(r[0], np.array(r[1], np.float32).astype(float), r[2]) for r in rows if ok(r)]
    linked, counts = [], {r[0]: 0 for r in rows}
    for k, (a, v, la) in enumerate(usable):
        for b, w, lb in usable[:k]:
            if la == lb and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= cosine:
                linked.append((a, b))
                counts[a] += 1
                counts[b] += 1
    roots = smallest_reachable(counts, linked)
    return {i: (counts[i], roots[i], roots[i] == i) for i in counts}


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        v = centres[i % 12] + rng.normal(size=16) * (0.05 if i % 3 else 0.35)
        rows.append((i, [float(x) for x in v], i % 5 if i % 12 else 7, "c", "r"))
    copy = rows[3]
    rows += [(500 + i, copy[1], copy[2], None, None) for i in range(40)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [nan] * 16, [inf] + [0.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(600 + i, v, copy[2], None, None) for i, v in enumerate(odd)]
    rows += [(700, copy[1], None, None, None), (701, [-x for x in copy[1]], copy[2], None, None)]
    got = near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(3), sample=64, block=32).collect()
    assert {r[0]: (r[1], r[2], r[3]) for r in got} == brute_vectors(rows)
    assert len(got) == len(rows)


def test_vectors_without_rows_or_ids(spark):
    assert near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(None, [1.0, 0.0], 1, None, None), (4, [1.0, 0.0], 1, None, None), (2, [1.0, 0.0], 1, None, None)]
    got = {r[0]: (r[1], r[2]) for r in near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == {None: (0, None), 4: (1, 2), 2: (1, 2)}


def test_vectors_that_share_an_id_keep_their_own_links(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 2), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 2), (3, [1.0, 0.02], 1)]
    got = near_duplicates(spark.createDataFrame([(*r, "c", "r") for r in rows], VECTORS))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1, True), (1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (3, 2, 1, False)]


def test_pieces_of_a_tile_are_joined(spark):
    rng = np.random.default_rng(9)
    vectors = np.concatenate([rng.normal(size=(1, 8)) + rng.normal(size=(60, 8)) * 0.2 for _ in range(6)])
    rows = [(i, [float(x) for x in v], 1, "c", "r") for i, v in enumerate(vectors)]
    classes = E.valid_classes(spark.createDataFrame(rows, VECTORS)).cache()
    axes = {8: E.principal_axes(classes, 8)}
    tiled = E.tiles(classes, axes, 0.93, 100).cache()
    count = lambda piece: sorted(map(tuple, E.compare_tiles(tiled, axes, 0.93, piece).collect()))
    assert count(7) == count(1024) and count(7)


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (100, 139), (200, 150)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    ids = {x for e in edges for x in e if e[0] != e[1]}
    assert got == smallest_reachable(ids, edges)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


HARD = [
    "",
    "\\",
    "[INST]",
    "\\[INST] \\\\</s>",
    "</s>[INST] ok [/INST]",
    " [/INST]</s>\n<s>user [INST] x",
    "<<s>s> [/INST",
    "\\\\\\[/INST]\\",
    "a\r\nb\x00é",
    "x" * 100_000,
]


@pytest.mark.parametrize("text", HARD)
def test_every_turn_survives(text):
    assert unescape(escape(text)) == text
    assert parse(render(text, "said")) == (text, "said")
    assert parse(render("user", text)) == ("user", text)
    assert "\\" in text or not any(c in text for c in ("<s>", "[INST]")) or escape(text) != text


def test_chat_digests_from_the_output(spark):
    rows = [(1, i, ("user", "assistant", None)[i % 3], t, "own") for i, t in enumerate([*HARD, None])]
    rows += [(None, 0, "assistant", "x", None), (2, None, "assistant", "b", None), (2, 1, "assistant", "c", None), (2, 1, "assistant", "c", None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, piece string")
    got = {r["conv_id"]: r for r in read_back(format_turns(turns.repartition(3))).collect()}
    assert set(got) == {1, 2, None}
    said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t, _ in rows[:11])
    loss = "".join(t or "" for _, _, r, t, _ in rows[:11] if r == "assistant")
    assert got[1]["n_turns"] == 11 and got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[1]["loss_chars"] == len(loss) and got[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[2]["loss_sha256"] == hashlib.sha256(b"bcc").hexdigest()
    assert read_back(format_turns(turns.limit(0))).count() == 0


def test_archives_round_trip(spark):
    long, trap = "é" * 700, "x" * 1000 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"
    rows = [(1, "http://a/ä b", long, 1), (9, None, long, 1), (5, "http://c", long, 1), (2, "u\r\nv", "short", 1), (3, "u", "short", 1)]
    rows += [(4, "u", None, 1), (6, "u", trap, 1), (7, "u", trap, 1), (8, "u", trap, 1), (8, "u", trap, 1), (None, "n", long, 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, path int")
    got = archive(pages.repartition(2), shared_folder(spark)).collect()
    seen = sorted((r["page_id"] or -1, r["kind"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in got)
    want = []
    last = {long: 9, trap: 8}
    twin = False
    for page, _, html, _ in rows:
        data = (html or "").encode()
        revisit = html in last and (page != last[html] or (page == 8 and twin))
        twin = twin or page == 8
        want.append((page or -1, "revisit" if revisit else "response", len(data), hashlib.sha1(data).hexdigest(), last[html] if revisit else None))
    key = lambda r: (r[0], r[1], r[2])
    assert sorted(seen, key=key) == sorted(want, key=key)
    assert archive(pages.limit(0), shared_folder(spark)).count() == 0
