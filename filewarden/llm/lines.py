"""Line dedup with a log-template tree of fixed depth.

A line is its words, those with a digit replaced by `<*>`. The tree has three levels: the number of words, the first
`LEAD` words, and a template per line. Within a leaf (number and leading words) a word is constant at a place if at
least `DOCS` documents have it there, else the place is variable; a template needs `CONSTANT` % constant places. Lines
that need fewer documents also have the templates whose constant words stand in as many documents as needed.

A template is dropped when `needed` unrelated documents hold it, fewer the longer it is. The owner of a line is the
smallest document that holds a template of it. For a template, documents of which another one owns at least `RELATED` %
of the words outside it count as one with that document, so copies and edited copies count once; documents without
other words count as one together. A block that is most of its hosts is thus taken for copied text and stays.

Cost: lines become narrow rows of digests, stored once; leaves are counted from them, and only lines of leaves with
enough documents go on. The text is shuffled twice, to read each different candidate line once and to remove lines. All joins
are plain equi-joins whose hot side Spark can split, all counts are pre-aggregated. Only built-in functions are used.

Null text: one empty line, never dropped. Lines under `LEAST` words are never dropped. A line that stands twice in a
document counts once for it and goes everywhere. Documents are told apart by id and text: rows that agree in both
count once and are treated alike. Documents are ordered by a digest of both. Other columns pass through. Empty input
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewarden.llm.text import let, lines, total, words
from filewarden.session import stored

LEAD = 3
LEAST = 3
DOCS = 10
CONSTANT = 70
RELATED = 50
NEEDED = ((50, 2), (20, 3), (10, 5))
ANY = "<*>"
WITH_DIGIT = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9]*[0-9])[^\x20\x09-\x0D]+"


def masked(line: Column) -> Column:
    """The words of a line, those with a digit as `ANY`."""
    return words(F.when(line.rlike("[0-9]"), F.regexp_replace(line, WITH_DIGIT, ANY)).otherwise(line))


def _leaf(tokens: Column) -> Column:
    return F.xxhash64(F.size(tokens), *[F.get(tokens, F.lit(k)) for k in range(LEAD)])


def needed(n: Column, docs: int = DOCS) -> Column:
    """How many unrelated documents drop a template of `n` words."""
    found = F.lit(docs)
    for least, few in sorted(NEEDED):
        found = F.when(n >= least, F.lit(min(few, docs))).otherwise(found)
    return found


def _line_rows(text: Column) -> Column:
    """Array of (line_no, leaf, line, words, of_text) of the lines with enough words; `line` is a digest.

    `words` counts those of the line, `of_text` those of all its lines.
    """

    def of_all(tokens: Column) -> Column:
        def rows(of_text: Column) -> Column:
            row = lambda t, i: F.struct(
                i.alias("line_no"),
                _leaf(t).alias("leaf"),
                F.xxhash64(t).alias("line"),
                F.size(t).alias("words"),
                of_text.alias("of_text"),
                (F.size(t) >= LEAST).alias("long"),
            )
            return F.filter(F.transform(tokens, row), lambda r: r.getField("long"))

        return let(total(F.transform(tokens, lambda t: F.size(t))), rows)

    return let(F.transform(lines(text), masked), of_all)


def _distinct_lines(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """The different lines (line, leaf, n, tokens) of `found`, with the number of their documents, read from `keyed`."""
    counted = found.groupBy("line", "leaf", "key").agg(F.min("line_no").alias("line_no"))
    weight = counted.groupBy("line", "leaf").agg(F.count("*").alias("n"), F.min(F.struct("key", "line_no")).alias("at"))
    wanted = weight.select(F.col("at.key").alias("key"), F.struct(F.col("at.line_no").alias("line_no"), "line", "leaf", "n").alias("w"))
    wanted = wanted.groupBy("key").agg(F.collect_list("w").alias("ws"))
    texts = keyed.join(wanted, "key").dropDuplicates(["key"]).select(lines(F.col("text")).alias("ls"), F.explode("ws").alias("w"))
    return stored(texts.select("w.line", "w.leaf", "w.n", masked(F.get("ls", F.col("w.line_no"))).alias("tokens")))


def _templates(distinct: DataFrame, docs: int, constant: int) -> DataFrame:
    """(line, template) of the different lines (line, leaf, n, tokens) whose template has enough constant places.

    A line has up to two templates: of the words that `docs` documents have there, and of those that as many have as
    the line needs. A leaf, place and word are one digest, so that narrow rows are counted and joined.
    """
    words_of = distinct.select("line", "leaf", "n", F.size("tokens").alias("size"), F.posexplode("tokens").alias("place", "word"))
    spread = words_of.filter(F.col("word") != ANY).select(
        "line", "size", "place", "n", needed(F.col("size"), docs).alias("needed"), F.xxhash64("leaf", "place", "word").alias("spot")
    )
    common = spread.groupBy("spot").agg(F.sum("n").alias("n"), F.min("needed").alias("needed")).filter("n >= needed")
    common = common.select("spot", (F.col("n") >= docs).alias("often"))
    fixed = spread.select("line", "size", "place", "spot").join(common, "spot")
    fixed = fixed.groupBy("line").agg(
        F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("place", "spot", "often"))).alias("enough")
    )
    fixed = fixed.select("line", "size", "enough", F.filter("enough", lambda x: x.getField("often")).alias("often"))
    spots = lambda name: F.transform(name, lambda x: x.getField("spot"))
    template = lambda name: F.when(F.size(name) * 100 >= F.col("size") * constant, F.xxhash64(spots(name)))
    shapes = F.array_distinct(F.array_compact(F.array(template("often"), template("enough"))))
    return fixed.select("line", F.explode(shapes).alias("template"))


def _classes(lined: DataFrame, related: int) -> DataFrame:
    """(template, n, cls) of every host of a template; hosts that count as one document have one `cls`."""
    of_owner = lined.filter("owner <> key").groupBy("key", "owner").agg(F.sum("words").alias("w"))
    tops = of_owner.groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct("w", "owner")), asc=False), 1, 2).alias("tops"))
    hosts = lined.select("key", "words", "of_text", "owner", F.explode("templates").alias("template")).groupBy("template", "key")
    hosts = hosts.agg(F.sum("words").alias("own"), F.max("words").alias("n"), F.max("of_text").alias("of_text"), F.min("owner").alias("owner"))
    outside = lambda x: F.struct(
        (x.getField("w") - F.when(x.getField("owner") == F.col("owner"), F.col("own")).otherwise(0)).alias("w"), x.getField("owner").alias("owner")
    )
    both = hosts.join(tops, "key", "left").withColumn("best", F.array_max(F.transform("tops", outside)))
    rest = F.col("of_text") - F.col("own")
    copied = (F.col("best.w") > 0) & (F.col("best.w") * 100 >= rest * related)
    return both.select("template", "n", F.when(rest <= 0, F.lit(0)).when(copied, F.col("best.owner")).otherwise(F.col("key")).alias("cls"))


def shared_lines(keyed: DataFrame, docs: int = DOCS, constant: int = CONSTANT, related: int = RELATED) -> DataFrame:
    """(key, dropped: line numbers) of `keyed` (key, text): lines of templates that enough unrelated documents hold."""
    every = stored(keyed.select("key", F.inline(_line_rows(F.col("text")))).drop("long"))
    leaves = every.groupBy("leaf").agg(F.count("*").alias("n"), F.max("words").alias("words"))
    leaves = leaves.filter(F.col("n") >= needed(F.col("words"), docs)).select("leaf")
    found = stored(every.join(leaves, "leaf", "left_semi").select("key", "line_no", "leaf", "line", "words", "of_text"))
    distinct = _distinct_lines(keyed, found)
    shaped = stored(found.join(_templates(distinct, docs, constant), "line").select("key", "line_no", "words", "of_text", "template"))
    owners = shaped.groupBy("template").agg(F.min("key").alias("owner"))
    lined = shaped.join(owners, "template").groupBy("key", "line_no").agg(
        F.max("words").alias("words"),
        F.max("of_text").alias("of_text"),
        F.min("owner").alias("owner"),
        F.collect_set("template").alias("templates"),
    )
    lined = stored(lined)
    counts = _classes(lined, related).distinct().groupBy("template", "n").agg(F.count("*").alias("docs"))
    recurring = counts.filter(F.col("docs") >= needed(F.col("n"), docs)).select("template")
    gone = lined.select("key", "line_no", F.explode("templates").alias("template")).join(recurring, "template", "left_semi")
    return gone.groupBy("key").agg(F.collect_set("line_no").alias("dropped"))


def document_key() -> Column:
    """60 bits of a digest of id and text."""
    both = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("bigint")


def dedup_lines(docs: DataFrame, **settings) -> DataFrame:
    """`docs` with `text` without shared lines, and `n_lines` and `n_dropped` behind its columns."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    gone = shared_lines(docs.select(document_key().alias("key"), "text"), **settings)
    whole = docs.select(document_key().alias("__key"), *[F.col(f"`{c}`") for c in names])
    joined = whole.join(gone.select(F.col("key").alias("__key"), F.col("dropped").alias("__dropped")), "__key", "left")
    kept = lambda ls: F.filter(ls, lambda line, i: ~F.array_contains("__dropped", i))
    text = F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(F.array_join(kept(lines(F.col("text"))), "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names],
        F.size(lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
