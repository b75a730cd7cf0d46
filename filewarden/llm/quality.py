"""Quality rules, line first: failing lines go, then documents that lost too much text are rejected.

Everything is computed in the row by built-in functions: no shuffle, no Python. The rules of a line:

* punctuation: at least `MIN_MARKS` marks that prose rarely holds, and at least `MARK_PERCENT` % of its characters;
* navigation: at least `MIN_BARS` bars between short items, and one for every five words or more;
* boilerplate: a short line with a fixed phrase, or a line of at least `MIN_REPEAT` words of which no more than a
  fifth differ. A line of more than `REPEAT_WINDOW` words is judged in windows of so many, because the share of
  different words falls with the length of any text: it fails if more than half of the windows do, or if no more than
  a fifth of its words differ and more than half of them stand in repeated windows of `WINDOW` words.

A line without words never fails. Rejected are texts that fail the base rule (under 20 words, or over 30 % of the
words in repeated windows) and texts that lose more than `LOST_PERCENT` % of their words.

Null text: no words, so the base rule rejects it. Windows are compared by 64-bit hashes within one text. Rows are
independent: repeated rows, ties and other columns, whatever their names, pass through unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewarden.llm.text import let, lines, matches, total, words

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[#*$%&|<>!~^={}\\]"
MIN_MARKS = 5
MARK_PERCENT = 10
MIN_BARS = 3
MIN_REPEAT = 10
REPEAT_WINDOW = 100
SHORT_LINE = 30
LOST_PERCENT = 50
PHRASES = (
    "all rights reserved|cookie policy|privacy policy|terms of (use|service)|"
    "enable javascript|javascript is disabled|click here|subscribe to our newsletter|lorem ipsum"
)


def repeated_words(found: Column) -> Column:
    """Words inside `WINDOW`-word windows that stand twice or more among the words `found`."""
    at = lambda i: F.xxhash64(*[F.get(found, i + k) for k in range(WINDOW)])
    last = F.size(found) - WINDOW
    hashes = F.transform(F.sequence(F.lit(0), last), at)

    def covered(keys: Column) -> Column:
        ordered = F.sort_array(F.transform(keys, lambda key, i: F.struct(key.alias("key"), i.alias("start"))))

        def starts(pairs: Column) -> Column:
            key = lambda i: F.get(pairs, i).getField("key")
            twin = lambda pair, i: pair.getField("key").eqNullSafe(key(i - 1)) | pair.getField("key").eqNullSafe(key(i + 1))
            return F.sort_array(F.transform(F.filter(pairs, twin), lambda pair: pair.getField("start")))

        widths = lambda s: total(F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.get(s, i + 1) - x)))
        twice = F.size(F.array_distinct(keys)) < F.size(keys)
        return F.when(twice, let(let(ordered, starts), widths)).otherwise(F.lit(0).cast("long"))

    return F.when(last < 1, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def _repeats(found: Column, window: int) -> Column:
    """Whether the words `found` of a line mostly repeat."""
    few = lambda some: F.size(F.array_distinct(some)) * 5 <= F.size(some)
    n = F.size(found)
    part = lambda i: F.slice(found, F.least(i * window, n - window) + 1, F.lit(window))
    parts = F.sequence(F.lit(0), F.ceil(n / window).cast("int") - 1)
    failing = F.size(F.filter(parts, lambda i: few(part(i))))
    long = (failing * 2 > F.size(parts)) | (few(found) & (repeated_words(found) * 2 > n))
    return F.when(n < MIN_REPEAT, F.lit(False)).when(n <= window, few(found)).otherwise(long)


def judged_lines(text: Column, window: int = REPEAT_WINDOW) -> Column:
    """Array of (line, words, failed) of a text."""

    def judge(line: Column) -> Column:
        def facts(found: Column) -> Column:
            n = F.size(found)
            marks, bars = matches(line, MARKS), matches(line, r"\|")
            punctuation = (marks >= MIN_MARKS) & (marks * 100 >= F.length(line) * MARK_PERCENT)
            navigation = (bars >= MIN_BARS) & (bars * 5 >= n)
            phrase = (n <= SHORT_LINE) & line.rlike(f"(?i)({PHRASES})")
            failed = (n > 0) & (punctuation | navigation | phrase | _repeats(found, window))
            return F.struct(line.alias("line"), n.alias("words"), failed.alias("failed"))

        return let(words(line), facts)

    return F.transform(lines(text), judge)


def quality_columns(text: Column, window: int = REPEAT_WINDOW) -> Column:
    """Struct of the base counts, the verdict and the cleaned text of a text."""
    n_long = lambda value, name: value.cast("long").alias(name)
    with_word = lambda judged: F.transform(
        F.filter(judged, lambda x: x.getField("words") > 0), lambda x: x.getField("line")
    )

    def of_lines(judged: Column) -> Column:
        kept = F.filter(judged, lambda x: ~x.getField("failed"))
        failed = F.filter(judged, lambda x: x.getField("failed"))
        return F.struct(
            let(with_word(judged), lambda x: n_long(F.size(x) - F.size(F.array_distinct(x)), "d")).alias("n_dup_lines"),
            n_long(F.size(failed), "n_failed_lines"),
            total(F.transform(failed, lambda x: x.getField("words"))).alias("n_lost_words"),
            F.array_join(F.transform(kept, lambda x: x.getField("line")), "\n").alias("clean_text"),
        )

    def of_words(found: Column) -> Column:
        return F.struct(
            n_long(F.size(found), "n_words"),
            n_long(F.length(F.array_join(found, "")), "word_chars"),
            repeated_words(found).alias("n_repeat_words"),
        )

    return F.struct(
        let(words(text), of_words).alias("w"),
        n_long(matches(F.coalesce(text, F.lit("")), SYMBOLS), "n_symbols"),
        let(judged_lines(text, window), of_lines).alias("l"),
    )


COLUMNS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "base_failed",
    "kept",
    "n_failed_lines",
    "n_lost_words",
    "clean_text",
)


def quality_rules(df: DataFrame, text: str = "text", window: int = REPEAT_WINDOW) -> DataFrame:
    """`df` with one struct column `quality` that holds `COLUMNS`.

    >>> quality_rules(docs).filter("quality.kept").select("doc_id", "quality.clean_text")  # doctest: +SKIP
    """
    q = let(quality_columns(F.col(text), window), _verdict)
    kept = [c for c in df.columns if c != "quality"]
    # A generated column: a filter on the verdict is not pushed into the rules, which would run twice.
    return df.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.array(q)).alias("quality"))


def _verdict(q: Column) -> Column:
    field = lambda *path: reduce(lambda c, name: c.getField(name), path, q)
    n, repeats, lost = field("w", "n_words"), field("w", "n_repeat_words"), field("l", "n_lost_words")
    failed = (n < MIN_WORDS) | (repeats * 100 > n * REPEAT_PERCENT)
    values = {
        "n_words": n,
        "word_chars": field("w", "word_chars"),
        "n_symbols": field("n_symbols"),
        "n_dup_lines": field("l", "n_dup_lines"),
        "n_repeat_words": repeats,
        "base_failed": failed,
        "kept": ~failed & (lost * 100 <= n * LOST_PERCENT),
        "n_failed_lines": field("l", "n_failed_lines"),
        "n_lost_words": lost,
        "clean_text": field("l", "clean_text"),
    }
    return F.struct(*[values[name].alias(name) for name in COLUMNS])
