import hashlib
import random
import struct

import duckdb
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from filewarden.llm import queries, sql
from filewarden.llm.bpe import Transducer, decode, encode, sufficient_lookahead
from filewarden.llm import licenses
from filewarden.llm.licenses import scan_licenses
from filewarden.llm.lines import dedup_lines
from filewarden.llm.mixing import mix, source_targets, with_copies
from filewarden.llm.ngrams import near_copies
from filewarden.llm.quality import quality_rules
from filewarden.llm.substrings import COVER, PERIOD, drop_repeated
from tests.llm.fixtures import DOCS, brute_components, brute_removed, documents, prose, words

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    return path


def sorted_rows(frame):
    plain = frame[sorted(frame.columns)].astype(object).map(lambda v: None if pd.isna(v) else f"{v:.9g}" if isinstance(v, int | float) else str(v))
    return sorted(map(tuple, plain.values.tolist()), key=str)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_source_mix", "op8_line_dedup", "op9_license_scan", "op10_substring_dedup"])
def test_awkward_rows_match_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    want = con.execute(queries.llm_oracles()[name]).df()
    got = queries.llm_queries()[name](spark, folder).toPandas()
    assert sorted_rows(got) == sorted_rows(want)


def test_empty_tables(spark, none):
    assert quality_rules(none).count() == 0
    assert with_copies(none).count() == 0
    assert mix(none).count() == 0
    assert near_copies(none).count() == 0
    assert decode(encode(none, PATH), PATH).count() == 0
    assert dedup_lines(none).count() == 0
    assert scan_licenses(none).count() == 0
    assert drop_repeated(none).count() == 0


def test_quality_keeps_prose_and_other_columns(spark, docs):
    found = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    assert found[0]["quality"]["kept"] and found[0]["quality"]["clean_text"] == found[0]["text"]
    assert found[0]["size"] == "own size"
    assert found[16]["quality"]["clean_text"] == found[16]["text"].split("\n")[1]
    assert not found[11]["quality"]["kept"] and not found[7]["quality"]["kept"]


def test_targets_stop_at_three_times_and_add_up(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 40), ("z", 0)], "source string, size bigint")
    got = {r["source"]: r for r in source_targets(sizes).collect()}
    assert got["a"]["target"] == 30
    assert all(r["target"] <= 3 * r["source_size"] + 1e-9 for r in got.values())
    assert abs(sum(r["target"] for r in got.values()) - 1550) < 1e-6
    assert got[None]["weight"] == 2 and got["z"]["target"] == 0


def test_mix_comes_near_its_targets_and_repeats(spark):
    rows = [(i, prose(i, 5 + i * 7 % 90), "abc"[i % 7 % 3]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    counted = with_copies(docs, slices=8).collect()
    assert sorted(counted) == sorted(with_copies(docs.repartition(5), slices=8).collect())
    taken, target = {}, {}
    for r in counted:
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)
    mixed = mix(docs, slices=8)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in counted)


def test_mix_of_awkward_rows(docs):
    counts = with_copies(docs)
    assert counts.count() == docs.count()
    assert mix(docs).count() == sum(r["copies"] for r in counts.collect())
    assert mix(docs).columns == docs.columns


def test_ngram_join_matches_brute_force(spark, docs, rows):
    with_id = {r[0]: r[1] for r in rows if r[0] is not None}
    got = near_copies(docs, slice_bytes=50_000).collect()
    assert len(got) == len(rows)
    want = brute_components(with_id.items())
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert want[2][1] == 0
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)


def test_ngram_join_of_large_near_group_in_tiles(spark):
    base = prose(50, 120).split()
    texts = []
    for i in range(60):
        w = list(base)
        w[(i * 7) % 120] = f"x{i}"
        if i % 3 == 0:
            w[(i * 11 + 5) % 120] = f"y{i}"
        texts.append((i, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = near_copies(docs, tile=16, percent=92)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(texts, 92)


def test_substrings_match_brute_force(docs, rows):
    got = {(r["doc_id"], r["n_words"]): r["kept"] for r in drop_repeated(docs, chunk_bytes=20_000).collect()}
    want = brute_removed([r[1] for r in rows])
    assert got == {(r[0], len(words(r[1]))): " ".join(w) for r, w in zip(rows, want)}


def test_cover_has_every_difference(docs):
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    with pytest.raises(ValueError):
        drop_repeated(docs, cover=(0, 1))


def test_bpe_equals_the_library(spark, docs, rows):
    library = Tokenizer.from_file(PATH)
    got = decode(encode(docs, PATH, window=4), PATH, block=5).collect()
    assert len(got) == len(rows) and got[0]["size"] in ("own size", None)
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"])) == ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_bpe_query_digests(spark, folder, rows):
    library = Tokenizer.from_file(PATH)
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op7_bpe(spark, folder).collect()}
    want = set()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.add((r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want


def test_bpe_long_pieces_in_small_windows():
    library, machine = Tokenizer.from_file(PATH), Transducer(PATH, window=1)
    for seed in range(4):
        text = prose(seed, 1500).replace(" ", "")
        got = b"".join(machine.encode(text))
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == library.encode(text, add_special_tokens=False).ids


def test_lookahead_of_a_small_merge_list():
    # (a, b) blocks (x, a): the next symbol decides a token that ends before it.
    assert sufficient_lookahead([("a", "b"), ("x", "a")]) == 2 + 2
    assert sufficient_lookahead([]) == 1


def test_sql_texts_exist():
    assert all(v.strip() for k, v in vars(sql).items() if k.startswith("OP"))


def test_labels_of_rows_that_share_an_id_or_have_none(spark):
    held = dict(licenses.TEMPLATES)
    rows = [(None, "this work is dedicated to the public domain"), (None, "plain words only here"), (1, held["mit-text"]), (1, "plain words"), (1, held["zlib"])]
    got = sorted((r["doc_id"] or 0, r["labels"]) for r in scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(0, ""), (0, "public-domain"), (1, ""), (1, "mit-text"), (1, "zlib")]


def test_whole_templates_are_found_wherever_they_stand(spark):
    """Against the definition: a block of the template's length holds enough of its different words."""
    r, rows = random.Random(8), []
    for i, (label, text) in enumerate(licenses.TEMPLATES):
        found = licenses.template_words(text)
        for k, lost in enumerate((0, len(set(found)) // 12, len(set(found)) // 4 + 1)):
            gone = set(r.sample(sorted(set(found)), lost))
            rows.append((10 * i + k, prose(i, r.randint(0, 700)) + " " + " ".join(w for w in found if w not in gone) + " " + prose(i + 50, 300)))
    got = {x["doc_id"]: set(x["labels"].split(",")) for x in scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for doc_id, text in rows:
        words = licenses.template_words(text)
        want = set()
        for label, body in licenses.TEMPLATES:
            t, n = set(licenses.template_words(body)), licenses.block_of(len(licenses.template_words(body)))
            blocks = [set(words[s : s + n]) for s in range(0, max(len(words) - n // 2, 1), n // 2)]
            want |= {label for b in blocks if len(t & b) * 100 >= len(t) * 90}
        assert got[doc_id] - {"gpl", "apache", "cc-by", "mit"} - {""} == want
        label = licenses.TEMPLATES[doc_id // 10][0]
        assert (label in want) == (doc_id % 10 < 2), (doc_id, label, want)
