"""Files of token ids: any place is read alone, and documents come back as the library encodes them."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from filewarden.llm import direct as D
from tests.llm.fixtures import DOCS, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 513, 5000])
@pytest.mark.parametrize("most", [1, 200, 70_000, 1 << 32])
def test_any_id_by_its_place(n, most):
    ids = np.random.default_rng(n).integers(0, most, n, dtype=np.uint64).astype(np.uint32)
    file = D.TokenFile(3, 4, [1, None], np.array([n // 2, n]), D.DirectCodes.of(ids))
    back = D.TokenFile.unpack(file.pack() + b"\n")
    assert (back.partition, back.number, back.doc_ids, back.ends.tolist()) == (3, 4, [1, None], [n // 2, n])
    if n:
        places = np.random.default_rng(1).integers(0, n, 300)
        assert (back.codes.at(places) == ids[places]).all()
    for a, b in [(0, n), (n // 3, n), (n // 2, n // 2), (min(9, n), min(600, n))]:
        assert (back.codes.run(a, b) == ids[a:b]).all()


def test_other_bytes_are_no_file():
    with pytest.raises(ValueError):
        D.TokenFile.unpack(b"x" * 60)
    data = D.TokenFile(0, 0, [1], np.array([1]), D.DirectCodes.of(np.array([300], np.uint32))).pack()
    with pytest.raises(ValueError):
        D.TokenFile.unpack(data + b"\n\n")


def texts():
    r = random.Random(3)
    odd = [" ", "  ", "\n", "\n\n ", "\t", " ", "　", "\x1c", "\x85", "᠎", "​", " ", "'s", "'", "don't", "é", "é",
           "a", "B", "12", "½", "²", "!!", "<|endoftext|>", "漢字", "😀", "\U0001f468‍\U0001f469", "\x00", "ǅ", "٠", "_", "x" * 70]
    return ["".join(r.choices(odd, k=r.randint(0, 30))) for _ in range(1500)]


def test_pieces_are_encoded_like_whole_texts():
    library, own = Tokenizer.from_file(PATH), D.Encoder(PATH)
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)


def test_plain_pieces_are_split_like_all_others():
    library, own, r = Tokenizer.from_file(PATH), D.Encoder(PATH), random.Random(4)
    chars = "abzAZ'.,!-_`~^ªµºÀéßÿĀſƀǅɏ×÷¡¿½²sdtmrelv"
    for _ in range(4000):
        piece = r.choice(["", " "]) + "".join(r.choices(chars, k=r.randint(1, 9)))
        ids = library.encode(piece, add_special_tokens=False).ids
        assert own[piece] == struct.pack(f"<{len(ids)}I", *ids), repr(piece)


def test_forgotten_pieces(monkeypatch):
    monkeypatch.setattr(D, "CACHE", 5)
    library, own = Tokenizer.from_file(PATH), D.Encoder(PATH)
    for text in ["a b c", "a b d e f", "a b c d e f g h", "a a a", "h g"]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def want(rows):
    library, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


@pytest.mark.parametrize("file_ids", [1 << 22, 50])
def test_documents_come_back_in_order(spark, tmp_path, file_ids):
    rows = [r for r in documents() if r[0] is not None and r[0] != 7] + [(500, "tail", None, None, 0, "n", "n")]
    rows = list(dict(zip([r[0] for r in rows], rows)).values())
    docs = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), DOCS).repartition(3)
    got = D.token_output(docs, PATH, str(tmp_path), file_ids=file_ids).collect()
    assert sorted(map(tuple, got)) == want(sorted((r[0], r[1]) for r in rows))


def test_repeated_and_null_ids_share_the_line_without_gaps(spark, tmp_path):
    rows = [(5, "a"), (5, "a"), (5, "b c"), (None, "d"), (None, None), (None, "d"), (1, "")] * 40
    got = D.token_output(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), PATH, str(tmp_path), file_ids=30).collect()
    got = sorted(got, key=lambda r: r["start"])
    ends = [r["start"] + r["n_tokens"] for r in got]
    assert [r["start"] for r in got] == [0, *ends[:-1]]
    assert [r["doc_id"] for r in got] == [None] * 120 + [1] * 40 + [5] * 120
    count = lambda found: sorted((repr(r[0]), r[2], r[3]) for r in found)
    assert count(got) == count(want(rows))


def test_empty_table(spark, tmp_path):
    assert D.token_output(spark.createDataFrame([], "doc_id bigint, text string"), PATH, str(tmp_path)).count() == 0
