"""Every stage of the pipeline against SQL or a brute-force version, on what the stage before it kept."""

import hashlib
import re
import struct
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from filewarden.llm import queries
from tests.llm.fixtures import DOCS, brute_components, documents, words

MARKS = re.compile(r"[#*$%&|<>!~^={}\\]")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Folder per stage, as the rows written and read again; 0 is the input."""
    top = tmp_path_factory.mktemp("pipeline")
    paths = [f"{top}/{i}/documents.parquet" for i in range(len(corpus_pipeline.STAGES) + 1)]
    rows = [r for r in documents() if r[0] is not None]
    more = [(1000 + r[0], r[1], *r[2:]) for r in rows if r[0] in (0, 3)]
    spark.createDataFrame([r[:5] for r in rows + more], ", ".join(DOCS.split(", ")[:5])).repartition(2).write.parquet(paths[0])
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, spark.read.parquet(paths[i]), str(top)).write.parquet(paths[i + 1])
    return paths


def read(path):
    return duckdb.sql(f"SELECT * FROM read_parquet('{path}/*.parquet')").df().to_dict("records")


def oracle(name, path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return con.execute(queries.llm_oracles()[name]).df().to_dict("records")


def long_repeats(found):
    n = len(found)
    parts = [found[min(i, n - 100) : min(i, n - 100) + 100] for i in range(0, n, 100)]
    few = sum(len(set(p)) <= 20 for p in parts)
    seen = Counter(tuple(found[i : i + 8]) for i in range(n - 7))
    again = {p for i in range(n - 7) if seen[tuple(found[i : i + 8])] > 1 for p in range(i, i + 8)}
    return few * 2 > len(parts) or (len(set(found)) * 5 <= n and len(again) * 2 > n)


def line_fails(line):
    found = words(line)
    marks, bars = len(MARKS.findall(line)), line.count("|")
    return bool(found) and (
        (marks >= 5 and marks * 100 >= len(line) * 10)
        or (bars >= 3 and bars * 5 >= len(found))
        or (len(found) <= 30 and "all rights reserved" in line.lower())
        or (10 <= len(found) <= 100 and len(set(found)) * 5 <= len(found))
        or (len(found) > 100 and long_repeats(found))
    )


def test_stage_columns(stages):
    for path in stages[:-1]:
        assert set(read(path)[0]) == {"doc_id", "text", "lang", "source", "n_chars"}
        assert all(r["n_chars"] == len(r["text"] or "") for r in read(path)[:50] if path != stages[0])


def test_quality_stage(stages):
    kept = {r["doc_id"] for r in oracle("op1_quality_rules", stages[0]) if r["kept"]}
    before = {r["doc_id"]: r["text"] for r in read(stages[0])}
    after = {r["doc_id"]: r["text"] for r in read(stages[1])}
    assert set(after) == kept and {0, 1, 2, 3, 13} <= kept
    for i, text in after.items():
        assert text == "\n".join(x for x in before[i].split("\n") if not line_fails(x))


def test_line_stage(stages):
    want = Counter((r["doc_id"], r["kept_sha256"]) for r in oracle("op8_line_dedup", stages[1]))
    got = Counter((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in read(stages[2]))
    assert got == want
    assert any("Read page" in r["text"] for r in read(stages[1])) and not any("Read page" in r["text"] for r in read(stages[2]))


def test_near_copy_stage(stages):
    rows = read(stages[2])
    groups = brute_components({(r["doc_id"], r["text"]) for r in rows})
    want = Counter(r["doc_id"] for r in rows if groups[r["doc_id"]][1] == r["doc_id"])
    assert Counter(r["doc_id"] for r in read(stages[3])) == want
    assert len(want) < len({r["doc_id"] for r in rows})


def test_mix_stage(stages):
    want = Counter()
    for r in oracle("op4_source_mix", stages[3]):
        want[r["doc_id"]] += r["taken"] // r["size"] if r["size"] else 0
    assert Counter(r["doc_id"] for r in read(stages[4])) == Counter({k: v for k, v in want.items() if v})


def test_token_stage(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in read(stages[4]):
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[(r["doc_id"], struct.pack(f"<{len(ids)}I", *ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], bytes(r["ids"]), r["decoded_sha256"]) for r in read(stages[5])) == want


def test_whole_run(spark, stages):
    got = corpus_pipeline.run(spark, stages[0].removesuffix("/documents.parquet"))
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in read(stages[5]))


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], ", ".join(DOCS.split(", ")[:5]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0
