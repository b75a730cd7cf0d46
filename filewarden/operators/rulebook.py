"""Scans with many catalogue rules: the rules are data, so the plan does not grow with them.

Every rule has a needle, a text that all its matches must contain: of its literal parts the one that the fewest rules
share. One automaton over all needles goes over a file once and names the rules that may match; only their patterns
run, by built-in functions, on that file. Rules without a needle (alternatives at the top, no literal part) are tried on every file. Matches are returned with their
place in the file, so the whole match can be read again from there. Content is not shuffled for that.

More rules than one automaton should hold meet the files in joins, by a word that stands whole in all matches of a rule.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filewarden.functions import bytestring as bs
from filewarden.session import stored
from filewarden.sources.catalogue import SIGNATURE_CONFIDENCE, SIGNATURE_EXISTS, SIGNATURE_LINEAR, SIGNATURE_NEEDLES, java_regex

MAX_RULES = 100_000
LEAST_NEEDLE = 2
_SPACES = " \t\n\x0b\f\r"
_FRAMED = re.compile(r"(?<=([^a-z0-9_]))([a-z0-9_]+)(?=([^a-z0-9_]))")
_PIECE = re.compile(r"\\[^A-Za-z0-9]|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(|\)|[*+?]\??|\{[^}]*\}|[.^$|]|.", re.S)


def literal_parts(pattern: str, space: str = "") -> list[str]:
    """Lower-case ASCII texts that stand in every match of a delimited pattern.

    With a `space`, that stands for `\\s` and for every white space of the pattern.
    """
    closing = {"(": ")", "[": "]", "{": "}", "<": ">"}.get(pattern[0], pattern[0])
    end = pattern.rindex(closing)
    if "x" in pattern[end:] or "|" in pattern[1:end]:
        return []
    depth, run, found = 0, "", []
    for part in _PIECE.findall(pattern[1:end]):
        depth += (part == "(") - (part == ")")
        literal = part if len(part) == 1 and part not in "().^$*+?" else part[1] if part[0] == "\\" and not part[1].isalnum() else ""
        if space and (part == "\\s" or literal and literal in _SPACES):
            literal = space
        if part[0] in "*+?{" and part[:1] != literal:
            again = space and part[0] == "+" and run.endswith(space)
            found.append(run if again else run[:-1])  # the character before may be missing or repeated
            run = space if again else ""
        elif literal and not depth and literal.isascii():
            run += literal.lower()
        else:
            found.append(run)
            run = ""
    return [text for text in [*found, run] if len(text) >= LEAST_NEEDLE]


def framed_words(pattern: str) -> list[tuple[str, str, str]]:
    """Words that stand whole in every match of a pattern, with the character before and behind; ' ' is any white space."""
    return [found.groups() for text in literal_parts(pattern, " ") for found in _FRAMED.finditer(text)]


def needles(patterns: list[str]) -> list[str]:
    """A literal part of each pattern, '' where there is none: the rarest among the patterns, then the longest."""
    parts = [literal_parts(p) for p in patterns]
    held = Counter(text for own in parts for text in set(own))
    return [min(own, key=lambda text: (held[text], -len(text), text), default="") for own in parts]


@functools.lru_cache(maxsize=4)
def _automaton(rules_of: tuple[tuple[str, tuple[int, ...]], ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for text, rules in rules_of:
        found.add_word(text, rules)
    if rules_of:
        found.make_automaton()
    return found


def with_candidates(files: DataFrame, rules: list[tuple[int, tuple[str, ...]]]) -> DataFrame:
    """Files with readable content and `candidates`, the numbers of the rules (number, needles) that may match.

    A rule needs one of its needles.
    """
    by_needle: dict[str, list[int]] = {}
    for number, any_of in rules:
        for text in any_of:
            by_needle.setdefault(text, []).append(number)
    always = by_needle.pop("", [])
    shared = files.sparkSession.sparkContext.broadcast(tuple((text, tuple(numbers)) for text, numbers in by_needle.items()))

    def run(batches: Iterator[pa.RecordBatch]):
        automaton = _automaton(shared.value)
        for batch in batches:
            found = []
            for content in batch.column(batch.schema.names.index("content")):
                text = bytes(content.as_py()).lower().decode("latin-1")
                hits = {rules for _, rules in automaton.iter(text)} if shared.value else ()
                found.append(sorted({*always, *(n for rules in hits for n in rules)}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, "candidates"])

    schema = T.StructType([*files.schema.fields, T.StructField("candidates", T.ArrayType(T.IntegerType()))])
    return files.filter(F.col("content").isNotNull()).mapInArrow(run, schema)


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rules with the regex to run, its group, a cheaper test that has to hold first, and the pattern's framed words."""
    for batch in batches:
        patterns = batch.column("pattern").to_pylist()
        # Known patterns with several `.*` have an equal form in linear time, and needles of all their alternatives.
        regex = [(SIGNATURE_LINEAR[p], 1) if p in SIGNATURE_LINEAR else (java_regex(p), 0) for p in patterns]
        words = [[] if SIGNATURE_NEEDLES.get(p) else framed_words(p) for p in patterns]
        added = [
            pa.array([r for r, _ in regex], pa.string()),
            pa.array([part for _, part in regex], pa.int32()),
            pa.array([SIGNATURE_EXISTS.get(p, "") for p in patterns], pa.string()),
            pa.array([[dict(zip(("before", "word", "behind"), w)) for w in own] for own in words], _WORDS),
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "regex", "part", "exists", "words"])


_WORDS = pa.list_(pa.struct([(name, pa.string()) for name in ("before", "word", "behind")]))
_RULE = "rule_ord INT, name STRING, pattern STRING, severity STRING, description STRING, confidence DOUBLE"
_PREPARED = f"{_RULE}, regex STRING, part INT, exists STRING, words ARRAY<STRUCT<before: STRING, word: STRING, behind: STRING>>"
_SHOWN = ("rule_ord", "name", "severity", "description", "confidence")
_TRIED = (*_SHOWN, "regex", "part", "exists")


def _first_matches(tried: DataFrame, kept: list[str]) -> DataFrame:
    """The first match of its rule in each row of `tried`, which holds `kept`, a file's `__bytes` and a rule."""
    match = F.expr("IF(exists = '' OR __bytes RLIKE exists, regexp_extract(__bytes, regex, part), '')")
    # A generated column: neither the filter nor the columns below run the pattern again.
    tried = tried.select("*", F.explode(F.array(match)).alias("__match"))
    at = F.expr("instr(__bytes, __match)")
    before = F.expr("substring(__bytes, 1, instr(__bytes, __match) - 1)")
    return tried.filter("__match != ''").select(
        *kept,
        *_SHOWN,
        (at - 1).cast("bigint").alias("match_offset"),
        F.length("__match").cast("bigint").alias("match_length"),
        (at - F.length(F.replace(before, F.lit("\n"), F.lit("")))).cast("int").alias("line_number"),
    )


def _matches_by_needle(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches of `MAX_RULES` rules or about as many, found by one automaton and joined by broadcast."""
    kept = [c for c in files.columns if c != "content"]
    rows = rules.select("rule_ord", "pattern").collect()
    patterns = [r["pattern"] for r in rows]
    any_of = [SIGNATURE_NEEDLES[p][0] if SIGNATURE_NEEDLES.get(p) else (own,) for p, own in zip(patterns, needles(patterns))]
    numbered = with_candidates(files, list(zip([r["rule_ord"] for r in rows], any_of)))
    tried = numbered.select(*kept, bs.latin1(F.col("content")).alias("__bytes"), F.explode("candidates").alias("rule_ord"))
    return _first_matches(tried.join(F.broadcast(rules.select(*_TRIED)), "rule_ord"), kept)


def _rarest_words(rules: DataFrame) -> DataFrame:
    """(rule_row, before, word, behind): of every rule's framed words the one that the fewest rules share, then the longest."""
    words = rules.select("rule_row", F.explode("words").alias("w")).select("rule_row", "w.*").distinct()
    held = words.select("rule_row", "word").distinct().groupBy("word").agg(F.count("*").alias("held"))
    best = F.min_by(F.struct("before", "word", "behind"), F.struct("held", -F.length("word"), "word", "before", "behind"))
    return words.join(held, "word").groupBy("rule_row").agg(best.alias("w")).select("rule_row", "w.*")


def _word_regex(frames: list[tuple[str, str]]) -> str:
    """Regex for the words of a text that stand in one of the frames, pairs of characters."""
    spelled = lambda c: r" \t\n\x0B\f\r" if c == " " else f"\\x{ord(c):02x}"
    behind: dict[str, str] = {}
    for before, after in sorted(frames):
        behind[before] = behind.get(before, "") + spelled(after)
    return "|".join(f"(?<=[{spelled(c)}])[A-Za-z0-9_]++(?=[{after}])" for c, after in behind.items())


def _matches_by_word(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches of any number of rules that have framed words: files and rules meet in a join on such a word.

    A file emits its distinct words that stand in a frame that some rule uses; the frames, pairs of ASCII characters,
    are all that reaches the driver. The candidates come back to the file by a number made of path and content; files
    that share one by chance only get each other's candidates to try.
    """
    kept = [c for c in files.columns if c != "content"]
    rules = stored(rules.join(_rarest_words(rules), "rule_row").select("before", "word", "behind", *_TRIED))
    frames = [tuple(r) for r in rules.select("before", "behind").distinct().collect()]
    if not frames:
        return _matches_by_needle(files, rules.withColumn("pattern", F.lit("")).limit(0))
    words = _word_regex(frames)
    texts = files.select(*kept, bs.latin1(F.col("content")).alias("__bytes"), F.xxhash64("path", "content").alias("__file"))
    texts = texts.filter(F.col("__bytes").rlike(words))
    own = F.array_distinct(F.transform(F.regexp_extract_all("__bytes", F.lit(words), F.lit(0)), F.lower))
    asked = texts.select("__file", F.explode(own).alias("word")).distinct()
    candidates = asked.join(rules, "word").select("__file", *_TRIED)
    return _first_matches(texts.join(candidates, "__file"), kept)


def rule_matches(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The first match of every rule of the table `rules` in every file: columns of `files` without content, the rule,
    and `match_offset` (from 0), `match_length` and `line_number` of the match, all in bytes of the content.

    Up to `MAX_RULES` rules reach the driver and the tasks, and no content is shuffled. Of more rules, those with a
    framed word meet the files in joins; the others take one automaton for every `MAX_RULES` of them.
    """
    default = F.coalesce("confidence", F.lit(SIGNATURE_CONFIDENCE)).cast("double").alias("confidence")
    rows = rules.select("rule_ord", "name", "pattern", "severity", "description", default)
    prepared = stored(rows.mapInArrow(_prepared, _PREPARED).withColumn("rule_row", F.monotonically_increasing_id()))
    if prepared.count() <= MAX_RULES:
        return _matches_by_needle(files, prepared)
    loose = prepared.filter(F.size("words") == 0)
    found = _matches_by_word(files, prepared.filter(F.size("words") > 0))
    blocks = -(-loose.count() // MAX_RULES)
    for block in range(blocks):
        some = loose.filter(F.pmod(F.xxhash64("rule_row"), F.lit(blocks)) == block)
        found = found.unionByName(_matches_by_needle(files, some))
    return found


def matched_bytes(files: DataFrame, matches: DataFrame) -> DataFrame:
    """`matches` with `evidence`, the whole match, read from the files again by its place."""
    whole = files.select(F.col("path").alias("__path"), "content")
    joined = matches.join(whole, F.col("path") == F.col("__path"))
    part = F.expr("substring(content, CAST(match_offset + 1 AS INT), CAST(match_length AS INT))")
    return joined.select(*matches.columns, part.alias("evidence"))
