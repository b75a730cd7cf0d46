"""Scans with rules as data: needles lose no match, plans do not grow, matches are recoverable."""

import random
import re

import pytest
from pyspark.sql import functions as F

from filewarden import schema
from filewarden.operators import detect, rulebook
from filewarden.sources import catalogue as cat


@pytest.mark.parametrize(
    "pattern, text",
    [
        ("/eval\\s*\\(/", "eval"),
        ("/abcd?ef/", "abc"),
        ("/abcde*fgh+/i", "abcd"),
        ("/one|two/", ""),
        ("/(one)two/", "two"),
        ("/[abc]def{2}ghij/", "ghij"),
        ("~Shell_Exec\\(~", "shell_exec("),
        ("/ab.c/", "ab"),
        ("/a.c/", ""),
        ("/a\\bword/", "word"),
        ("#x y z#x", ""),
        ("/caf\u00e9s/", "caf"),
    ],
)
def test_needles(pattern, text):
    assert max(rulebook.literal_parts(pattern), key=len, default="") == text


def test_every_match_holds_the_needle():
    r, parts = random.Random(1), ["ab", "Cde", "x", "\\.", "\\s", "[xy]", "(ab)", ".", "f?", "g*", "h+", "cd{2}", "^", "$", " "]
    for _ in range(3000):
        body = "".join(r.choices(parts, k=r.randint(1, 7)))
        text = "".join(r.choices("abCcdDexyfgh. ", k=40))
        found = re.search(body, text, re.I)
        assert not found or all(part in found[0].lower() for part in rulebook.literal_parts(f"/{body}/i")), (body, text)


def test_needles_are_those_that_few_rules_share():
    assert rulebook.needles(["/item\\s+12;/", "/item\\s+13;/", "/items/", "/a|b/"]) == ["12;", "13;", "items", ""]


def rules_df(spark, rows):
    return spark.createDataFrame([(i + 1, "signature", n, p, "high", n, None) for i, (n, p) in enumerate(rows)], schema.RULES)


def test_default_rules_match_like_the_scan(spark, make_files):
    files = make_files({
        "/a.php": "x\n<?php eval(base64_decode($x)); shell_exec($_GET['a']);",
        "/b.php": b"\xff\xe9 c99 \xc3\xa9 UNION  select a from information_schema",
        "/c.php": "clean", "/d.php": "", "/e.php": "coinhive\nCOINHIVE stratum+tcp",
    })
    found = rulebook.rule_matches(files, cat.default_catalogue(spark))
    old = detect.signature_hits(files)
    key = lambda df, name: sorted(map(tuple, df.select("path", name, "severity", "line_number").collect()))
    assert key(found, "name") == key(old, "type") and len(key(found, "name")) >= 4


def test_whole_match_is_read_again(spark, make_files):
    long = "x" * 5000
    files = make_files({"/a": f"line\n\u00e9 begin{long}end tail", "/b": "begin only"})
    found = rulebook.rule_matches(files, rules_df(spark, [("span", "/begin.*end/"), ("none", "/zzz/")]))
    rows = rulebook.matched_bytes(files, found).collect()
    assert [(r["path"], r["match_length"], r["line_number"], bytes(r["evidence"]).decode()) for r in rows] == [("/a", 5008, 2, f"begin{long}end")]


def test_plans_do_not_grow_with_the_rules(spark, make_files):
    files = make_files({f"/{i}": f"item {i}; and item {i + 1}; x" for i in range(50)})
    plan = lambda n: rulebook.rule_matches(files, rules_df(spark, [(f"r{i}", f"/item\\s+{i};/") for i in range(n)]))
    size = lambda df: len(df._jdf.queryExecution().executedPlan().treeString().splitlines())
    assert size(plan(5)) == size(plan(3000))
    assert plan(3000).groupBy("path").count().filter(F.col("count") == 2).count() == 50


def test_no_files_and_no_rules(spark, make_files):
    files = make_files({"/a": "text"})
    assert rulebook.rule_matches(files.limit(0), cat.default_catalogue(spark)).count() == 0
    assert rulebook.rule_matches(files, cat.default_catalogue(spark).limit(0)).count() == 0


def test_words_that_stand_whole_in_every_match():
    assert rulebook.framed_words("/item\\s+12;/i") == [(" ", "12", ";")]
    assert rulebook.framed_words("/ A\\.b9 \\s?c;/") == [(" ", "a", "."), (".", "b9", " ")]
    assert rulebook.framed_words("/item\\s*12;/") == rulebook.framed_words("/x|y 1;/") == rulebook.framed_words("/ab 12/") == []


def test_framed_words_stand_in_every_match():
    r, parts = random.Random(2), ["ab", "C1", ";", "\\.", "\\s", "\\s+", " ", "[x ]", "(a )", "f?", " +", ";{2}", "\\s*", "\\b"]
    for _ in range(5000):
        body = "".join(r.choices(parts, k=r.randint(1, 8)))
        text = "".join(r.choices(["ab", "c1", "C1", ";", ".", " ", "\t", "\n", "x", "a "], k=30))
        found, frames = re.search(body, text, re.I), rulebook.framed_words(f"/{body}/i")
        for before, word, behind in frames if found else []:
            held = re.findall(rulebook._word_regex([(before, behind)]).replace("\\x0B", "\\x0b"), text)
            assert word in [w.lower() for w in held], (body, text)


def test_more_rules_than_one_automaton_holds(spark, make_files, monkeypatch):
    """Rules that meet files by a word, and blocks of rules that have none, find what one automaton finds."""
    r = random.Random(3)
    rules = [(f"w{i}", f"/item\\s+{i};/i") for i in range(60)] + [(f"n{i}", f"/item{i}/") for i in range(40)]
    rules += [("any", "/x|y/"), ("end", "/item.*;$/"), ("class", "/[ab] 7;/"), ("two", "/ 7; item 8;/i")]
    pick = lambda: r.choice(["Item {};", "item\t\n{};", "ITEM  {} ;", "xitem {};", "item{}", "({};", "Item {};Item {};", "\u00e9 {}; item 8;"])
    files = make_files({f"/{i}": "\n".join(pick().replace("{}", str(r.randint(0, 70))) for _ in range(6)) for i in range(80)} | {"/empty": ""})
    files = files.unionByName(files.limit(5)).unionByName(files.limit(1).withColumn("path", F.lit(None).cast("string")))
    got = lambda: sorted(map(tuple, rulebook.rule_matches(files.select("path", "content"), rules_df(spark, rules)).collect()), key=str)
    expected = got()
    monkeypatch.setattr(rulebook, "MAX_RULES", 15)
    assert got() == expected and len({row[2] for row in expected}) > 80
