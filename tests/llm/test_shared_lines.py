"""Lines that unrelated documents share go, wherever they stand; lines of copies stay."""

import pytest

from filewarden.llm.lines import dedup_lines
from tests.llm.fixtures import prose

BLOCK = ["Shared block starts with this line", "Middle of the shared block here", "Shared block ends with this line"]
NOTICE = "Read this short notice before you go"
WHOLE = "Nothing but this one line is here"
PASSAGE, LONG, ONCE = prose(901, 60), prose(902, 25), prose(903, 12)


def texts():
    out = {}
    for i in range(12):  # a block at the top, a notice between blank lines and between a few rotating lines
        out[i] = "\n".join([*BLOCK, prose(i, 40), "", NOTICE, "", prose(100 + i, 40)])
    for i in range(40):
        out[100 + i] = f"{prose(1000 + i, 40)}\nRotating line of kind {'abc'[i % 3]} here\nA notice between few rotating lines\nRotating line of kind {'abc'[i % 2]} here"
    for i in range(2):
        out[200 + i] = f"{prose(2000 + i, 70)}\n{PASSAGE}"
    for i in range(3):
        out[210 + i] = f"{prose(2100 + i, 70)}\n{LONG}\n{prose(2200 + i, 10)}"
    for i in range(4):  # too few for a line of 12 words
        out[220 + i] = f"{prose(2300 + i, 70)}\n{ONCE}"
    for i in range(30):  # edited copies of one document
        out[300 + i] = "\n".join(prose(3000 + k, 30) if k != i % 6 else prose(4000 + i, 30) for k in range(6))
    for i in range(30):  # copies of a document that holds the notice of others
        out[400 + i] = f"{prose(5000, 30)}\n{NOTICE}\n{prose(5001, 30)}"
    for i in range(20):
        out[500 + i] = WHOLE if i < 8 else f"{prose(6000 + i, 30)}\n{WHOLE}"
    return out


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.createDataFrame([*texts().items(), (0, texts()[0])], "doc_id bigint, text string").repartition(3)
    return {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()}


def gone(kept, *ids):
    return [sorted(set(texts()[i].split("\n")) - set(kept[i].split("\n"))) for i in ids]


def test_blocks_and_notices_go_whatever_stands_beside_them(kept):
    assert gone(kept, *range(12)) == [sorted([*BLOCK, NOTICE])] * 12
    assert all("A notice between few rotating lines" in g for g in gone(kept, *range(100, 140)))


def test_whole_texts_go_with_their_template(kept):
    assert gone(kept, *range(500, 520)) == [[WHOLE]] * 20


def test_longer_lines_need_fewer_documents(kept):
    assert gone(kept, 200, 201) == [[PASSAGE]] * 2
    assert gone(kept, 210, 211, 212) == [[LONG]] * 3
    assert gone(kept, *range(220, 224)) == [[]] * 4


def test_lines_of_copies_stay(kept):
    assert gone(kept, *range(300, 330)) == [[]] * 30
    assert gone(kept, *range(400, 430)) == [[NOTICE]] * 30
