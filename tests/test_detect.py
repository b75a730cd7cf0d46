"""Detectors against hand-checked rows (types, severities, confidences, lines)."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from filewarden.operators import detect, scan
from filewarden.settings import ScanSettings
from filewarden.sources import catalogue as cat

A = "A"
ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

# name -> (content, obfuscation score, expected rows in rank order), worked out from the rules by hand
S = "suspicious_function"
SNIPPETS = {
    "decoded_call": (
        "$run = eval( base64_decode ($blob) );",
        0.2,
        [(S, "high", 1.0, 1), ("eval_obfuscation", "high", 0.9, 1)],
    ),
    "page_by_name": (
        "<?php\ninclude ( $_POST[page] );",
        0.0,
        [("file_inclusion", "critical", 0.9, 2), ("dynamic_include", "high", 0.8, 2), ("user_input", "medium", 0.6, 2)],
    ),
    "shell_by_name": (
        "echo shell_exec( $_REQUEST[q] );",
        0.0,
        [("shell_exec", "critical", 0.9, 1), (S, "high", 1.0, 1), ("user_input", "medium", 0.6, 1)],
    ),
    "known_shell": ("// r57 was here", 0.0, [("backdoor_pattern", "critical", 0.9, 1)]),
    "long_literal": (
        f"$k = base64_decode('{A * 130}');",
        0.6000000000000001,
        [("base64_suspicious", "medium", 0.9, 1), (S, "low", 0.7, 1)],
    ),
    "miner_pool": ("pool: stratum+tcp one; coin: MONERO", 0.0, [("crypto_mining", "high", 0.9, 1)]),
    "plain_call": ("if ($a) { eval ( $a ); }", 0.0, [(S, "high", 0.9, 1)]),
    "read_input": ("print(\n$_GET ['n']);", 0.0, [("user_input", "medium", 0.6, 2)]),
    "include_variable": ("require 'x';\n\ninclude ( $part );", 0.0, [("dynamic_include", "high", 0.8, 3)]),
    "many_literals": (
        "".join(f'$v{i} = base64_decode("{A * 110}");\n' for i in range(6)),
        1.0,
        [("obfuscated_code", "medium", 1.0, 0), ("base64_suspicious", "medium", 0.9, 1), (S, "low", 0.7, 1)],
    ),
    "long_run": (f"key={ALNUM * 40}", 0.4, []),
    "remote_read": (
        "$page = file_get_contents('https://host.example/feed');",
        0.0,
        [(S, "medium", 0.5, 1)],
    ),
}


def entropy_of(data: bytes) -> float:
    counts = Counter(data).values()
    return -sum(n / len(data) * math.log2(n / len(data)) for n in counts)


EDGES = {
    "empty": ("", []),
    "server": ('include($_SERVER["x"])', [("file_inclusion", "critical", 0.9, 1), ("dynamic_include", "high", 0.8, 1)]),
    "cookie": (
        'include($_COOKIE["x"])',
        [("dynamic_include", "high", 0.8, 1), ("user_input", "medium", 0.6, 1)],
    ),
    "include_once": ("include_once($f)", [("dynamic_include", "high", 0.8, 1)]),
    "my_eval": ("my_eval($x)", []),
    "upper_eval": ("EVAL($x)", []),
    "upper_eval_b64": ("EVAL(base64_decode($x))", [(S, "high", 0.7, 1)]),
    "chr_loop_two_lines": ("for ($i = 0; $i < 9; $i++)\n chr($i);", []),
    "chr_loop": ("for ($i = 0; $i < 9; $i++) chr($i);", [("suspicious_pattern", "high", 0.8, 1)]),
    "behaviour_0.4+0.2": (
        "wp_users password $_SERVER['HTTP_X']",
        [("malicious_behavior", "high", 0.6000000000000001, 0)],
    ),
    "behaviour_0.3+0.3": ("admin user add; curl exec post", []),
    "seven_runs": (" ".join([A * 60] * 7) + " x" * 300, [("obfuscated_code", "medium", 0.7000000000000001, 0)]),
    "cr_only": ("a\rb\reval($x)", [(S, "high", 0.9, 1)]),
    "lines": ("a\nb\neval($x)", [(S, "high", 0.9, 3)]),
    "first_copy": ("// my_eval($x)\n\neval($x)", [(S, "high", 0.9, 1)]),
    "wso": ("awsome", [("backdoor_pattern", "critical", 0.9, 1)]),
    "byte_a9": (b"\xa9eval($x)", [(S, "high", 0.9, 1)]),
    "byte_aa": (b"\xaaeval($x)", [(S, "high", 0.9, 1)]),
    "byte_b5": (b"\xb5eval($x)", [(S, "high", 0.9, 1)]),
    "byte_e9": (b"\xe9eval($x)", [(S, "high", 0.9, 1)]),
    "object_call": ("$x->system($_GET[1])", [(S, "high", 1.0, 1), ("user_input", "medium", 0.6, 1)]),
    "replace": ("$a = 'x'; $b = str_replace($a)", [("suspicious_pattern", "medium", 0.7, 1)]),
    "sql": ("UNION  SELECT a FROM information_schema.x", [("sql_injection", "high", 0.9, 1)]),
    "sql_two_lines": ("UNION SELECT a\nFROM information_schema.x", []),
    "wp": ("wp_options siteurl update", [("wordpress_exploit", "critical", 0.9, 1)]),
    "remote": ("file_get_contents('http://x')", [(S, "medium", 0.5, 1)]),
}


def rows(spark_rows):
    out = {}
    for r in sorted(spark_rows, key=lambda r: (r["path"], r["rank"])):
        out.setdefault(r["path"], []).append((r["type"], r["severity"], r["confidence"], r["line_number"]))
    return out


def test_snippets(make_files):
    files = make_files({p: c for p, (c, *_) in SNIPPETS.items()})
    got = rows(scan.threats(scan.analyse(files)).collect())
    for path, (_, _, expected) in SNIPPETS.items():
        assert got.get(path, []) == expected, path


def test_snippet_scores(make_files):
    files = make_files({p: c for p, (c, *_) in SNIPPETS.items()})
    entropy = {r["path"]: r["entropy"] for r in detect.entropy_scores(files).collect()}
    by_histogram = {r["path"]: r["entropy"] for r in detect.histogram_entropy(files).collect()}
    obfuscation = {r["path"]: r["obfuscation_score"] for r in detect.obfuscation_scores(files).collect()}
    for path, (content, obf, _) in SNIPPETS.items():
        assert entropy[path] == pytest.approx(entropy_of(content.encode()), abs=1e-9)
        assert by_histogram[path] == pytest.approx(entropy[path], abs=1e-9)
        assert obfuscation[path] == obf


def test_edge_cases(make_files):
    files = make_files({p: c for p, (c, _) in EDGES.items()})
    got = rows(scan.threats(scan.analyse(files)).collect())
    for path, (_, expected) in EDGES.items():
        assert got.get(path, []) == expected, path


def test_multi_line_sample(make_files):
    text = "// start\n eval( $_POST[1] );\n$d = base64_decode('" + A * 100 + "');\nprint $_GET[2];\n"
    got = rows(scan.threats(scan.analyse(make_files({"x": text}))).collect())["x"]
    assert got == [
        (S, "high", 1.0, 2),
        ("base64_suspicious", "medium", 0.9, 3),
        ("user_input", "medium", 0.6, 2),
        (S, "low", 1.0, 3),
    ]


def test_evidence_is_cut_at_200_bytes_and_context_at_100(make_files):
    files = make_files({"long": "x" * 299 + ' base64_decode("' + A * 400 + '")' + "y" * 300})
    found = {r["type"]: r["evidence"] for r in scan.threats(scan.analyse(files)).collect()}
    assert found["base64_suspicious"] == 'base64_decode("' + A * 185
    assert found[S] == "x" * 99 + ' base64_decode("' + A * 85


def test_evidence_with_cut_utf8_stays_readable(make_files):
    files = make_files({"u": "é" * 120 + "eval($x)" + "é" * 120})
    evidence = scan.threats(scan.analyse(files)).first()["evidence"]
    assert "eval($x)" in evidence and evidence.startswith("é")


@pytest.mark.parametrize("threshold", [0.0, 0.05, 1.5])
def test_threshold_outside_its_range_is_an_error(threshold):
    with pytest.raises(ValueError):
        ScanSettings(confidence_threshold=threshold)


def test_threshold_is_monotone(make_files):
    contents = {p: c for p, (c, *_) in SNIPPETS.items()} | {p: c for p, (c, _) in EDGES.items()}
    files = make_files(contents | {"concat": "$a = $b . $c;", "noise": bytes(range(256)) * 4})
    found = {}
    for t in (0.1, 0.25, 0.4, 0.5, 0.8, 1.0):
        result = scan.threats(scan.analyse(files, settings=ScanSettings(confidence_threshold=t)))
        found[t] = {(r["path"], r["rule_ord"]) for r in result.collect()}
    assert found[0.1] >= found[0.25] >= found[0.4] >= found[0.5] >= found[0.8] >= found[1.0]
    assert ("noise", cat.ENTROPY_ORD) in found[0.25] and ("noise", cat.ENTROPY_ORD) not in found[0.4]
    assert ("concat", cat.PATTERN_ORD + 1) in found[0.4] and ("concat", cat.PATTERN_ORD + 1) not in found[0.5]


def test_high_entropy_row(make_files):
    files = make_files({"noise": bytes(range(256)) * 4})
    row = scan.threats(scan.analyse(files, settings=ScanSettings(confidence_threshold=0.1))).filter(
        "type = 'high_entropy'"
    ).first()
    assert (row["confidence"], row["evidence"], row["line_number"]) == (0.25, "Entropy score: 8", 0)


def test_needles_never_hide_a_match(spark, make_files):
    """Same rows with and without the substring guards."""
    contents = {p: c for p, (c, *_) in SNIPPETS.items()} | {p: c for p, (c, _) in EDGES.items()}
    files = make_files(contents)
    guarded = detect.signature_hits(files)
    bare = detect.signature_hits(
        files, [cat.Rule(**{**r.__dict__, "needles": (), "exists": "", "linear": ""}) for r in cat.default_signatures()]
    )
    assert sorted(guarded.collect()) == sorted(bare.collect())


def test_linear_tests_equal_their_patterns(spark):
    """Every linear-time form agrees with its pattern, on crafted and on random texts."""
    import random

    words = ["wp_users", "password", "md5", "admin", "user", "add", "CURL", "curl", "exec", "post", "mail", "(", ")"]
    words += ["@", "\n", " ", "\r", "union", "select", "from", "information_schema", "wp_options", "siteurl", "update"]
    rng = random.Random(7)
    texts = ["".join(rng.choices(words, k=rng.randint(2, 9))) for _ in range(4000)]
    texts += ["mail(x mail\n(@)", "mail\n\n (a@b)", "mail(\n@)", "union\nselect from information_schema", "union \n\t select a"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    pairs = [(p, test) for (p, _), (_, test) in zip(cat.BEHAVIOURS, cat.BEHAVIOUR_TESTS)]
    pairs += [(r.pattern, r.exists) for r in cat.default_signatures() if r.exists]
    checks = [F.count_if(F.col("t").rlike(p) != F.col("t").rlike(x)).alias(f"d{i}") for i, (p, x) in enumerate(pairs)]
    hits = [F.count_if(F.col("t").rlike(p)).alias(f"h{i}") for i, (p, _) in enumerate(pairs)]
    row = df.agg(*checks, *hits).first()
    assert all(row[f"d{i}"] == 0 for i in range(len(pairs)))
    assert sum(row[f"h{i}"] > 0 for i in range(len(pairs))) >= len(pairs) - 2


def test_linear_first_matches_equal_their_patterns(spark):
    import random

    words = ["$_GET", "$_POST", "[", "]", "for", "(", "$i", "=", "0", "chr", "chr(", "union", "select", "from"]
    words += ["information_schema", "\n", " ", "\r", "for($i=0", "$_GET[", "UNION SELECT"]
    tables = ["wp_users", "password", "MD5", "md5", "wp_options", "siteurl", "update", "\n", " ", "\r", "x"]
    rng = random.Random(11)
    texts = ["".join(rng.choices(words, k=rng.randint(2, 12))) for _ in range(6000)]
    texts += ["".join(rng.choices(tables, k=rng.randint(3, 14))) for _ in range(6000)]
    heads = ["$_GET\n[ ]", "$_GET[ $_GET\n[ ]", "for(\n$i=0 for($j=0\n chr(", "for($i=0 for(\n$j=0 chr\n(", "union\nselect from from information_schema from"]
    df = spark.createDataFrame([(t,) for t in texts + heads], "t STRING")
    rules = [r for r in [*cat.default_signatures(), *cat.HEURISTICS, *cat.PATTERNS] if r.linear]
    assert len(rules) == 4
    pairs = [(F.regexp_extract("t", r.pattern, 0), F.regexp_extract("t", r.linear, 1)) for r in rules]
    row = df.agg(
        *[F.count_if(a != b).alias(f"d{i}") for i, (a, b) in enumerate(pairs)],
        *[F.count_if(a != "").alias(f"h{i}") for i, (a, _) in enumerate(pairs)],
    ).first()
    assert [row[f"d{i}"] for i in range(4)] == [0] * 4 and all(row[f"h{i}"] > 5 for i in range(4))


def test_long_lines_without_a_match_stay_cheap(make_files):
    """Megabyte lines of unfinished starts: quadratic patterns would not return."""
    import time

    contents = {
        "input": "$_GET[" * 300_000,
        "loop": "for($i=0 " * 200_000 + "\nchr",
        "sql": "union select from " * 100_000 + "\ninformation_schema",
        "mail": "mail(@" * 300_000 + "\n)",
        "admin": "admin user " * 150_000 + "\nadd",
    }
    start = time.time()
    assert scan.threats(scan.analyse(make_files(contents))).count() == 0
    late = "wp_users " * 40_000 + "password " * 40_000 + "\nwp_users password md5"
    found = scan.threats(scan.analyse(make_files({"late": late}))).filter("type = 'wordpress_exploit'").first()
    assert found["evidence"] == "wp_users password md5"
    assert time.time() - start < 60


def test_long_run_block_is_necessary(spark):
    rows = [("x " * a + "Z" * n + " y",) for a in range(0, 30, 3) for n in range(45, 80)]
    df = spark.createDataFrame(rows, "t STRING")
    bad = df.filter(F.col("t").rlike(cat.LONG_RUN) & ~F.col("t").rlike(cat.LONG_RUN_BLOCK)).count()
    assert bad == 0 and df.filter(F.col("t").rlike(cat.LONG_RUN)).count() == 300


@pytest.mark.parametrize(
    "text, expected",
    [("", 0), ("-", 0), ("'-", 0), ("--", 0), ("a", 1), ("don't stop-it", 2), ("- a", 1), ("a -", 1), ("1 b2c d", 3)],
)
def test_word_count(spark, text, expected):
    from filewarden.functions.text import word_count

    assert spark.range(1).select(word_count(F.lit(text)).alias("n")).first()["n"] == expected


def test_entropy_matches_definition(make_files):
    data = {"a": b"\x00\xff" * 10, "b": b"hello world", "c": b"", "d": bytes(range(256))}
    got = {r["path"]: r["entropy"] for r in detect.entropy_scores(make_files(data)).collect()}
    for path, value in data.items():
        expected = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) if value else 0
        assert got[path] == pytest.approx(expected, abs=1e-12)


def test_byte_histogram(make_files):
    got = {(r["byte_value"], r["n"]) for r in detect.byte_histogram(make_files({"a": b"\x00\xffA\xff"})).collect()}
    assert got == {(0, 1), (255, 2), (65, 1)}


def test_top_threat(make_files):
    files = make_files({p: c for p, (c, *_) in SNIPPETS.items()})
    top = {r["path"]: r["type"] for r in detect.top_threat(scan.analyse(files)).collect()}
    assert top == {p: e[0][0] for p, (*_, e) in SNIPPETS.items() if e}


def test_analysis_is_one_stage_without_exchange_or_python(make_files):
    plan = scan.analyse(make_files({"a": "eval($x)"}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ArrowEval" not in plan


def test_unreadable_content_is_skipped(spark):
    files = spark.createDataFrame([("a", None), ("b", bytearray(b"eval($x)"))], "path STRING, content BINARY")
    assert [r["path"] for r in scan.analyse(files).collect()] == ["b"]


def test_results_rows_are_stable(make_files):
    from datetime import datetime

    files = make_files({"/a.php": SNIPPETS["page_by_name"][0]})
    first = scan.scan_results(scan.analyse(files), "s1", datetime(2024, 1, 2)).collect()
    again = scan.scan_results(scan.analyse(files), "s1", datetime(2024, 1, 2)).collect()
    assert first == again and len({r["id"] for r in first}) == 3
    assert [str(r["confidence_score"]) for r in first] == ["0.90", "0.80", "0.60"]
    assert {r["status"] for r in first} == {"active"}
