"""Mixing sources to target weights by systematic sampling of whole documents.

Every source gets a target share of all words: weights go to the sources in code point order (a null source last),
no target exceeds `MOST` times the words of its source, and what exceeds is shared again by weight. With
`rate = target / words of the source` every document of a source is expected `rate` times. The documents of a source
stand in a fixed order; their expected copies are summed along it, one offset per source is added, and a document is
emitted once per integer boundary that its interval crosses. The order follows the size (in steps of about 3 %), so
that every stretch of sizes is taken at the same rate and the words taken stay near the target.

The prefix sum never gathers a source: documents are counted per (source, size step, slice), steps are summed within
a source and slices within a step, and only the rank inside a slice needs the documents. There are at most some
thousand steps a source and `SLICES` slices a step, and a hot source, even one of copies of one text, is spread over
all its slices.

Null or empty text: size 0, never taken. A null source is a source of its own. Documents with equal ids are ordered by
size and are otherwise interchangeable, so the rows of a rerun agree. Empty input gives an empty result. Only built-in
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filewarden.llm.text import words
from filewarden.session import stored

WEIGHTS = (5, 2, 1)
MOST = 3
SLICES = 1024
SEED = "mix"


def size_step(size: Column) -> Column:
    """A step number that grows with the size; a step spans about 3 % of it."""
    bits = F.length(F.bin(size))
    shift = F.greatest(bits - 6, F.lit(0))
    return (shift * 64 + F.floor(size / F.pow(F.lit(2.0), shift))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source of `sizes` (source, size): source_size, weight, target.

    The targets are the level at which the capped weights add up to all words: sources in the order in which they
    reach their cap, with what is left after each. The table holds one row per source, never documents.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = table.withColumn("rank", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_need = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_need.rowsBetween(W.unboundedPreceding, -1)
    after = by_need.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    stepped = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("all"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped"),
        F.sum("weight").over(after).alias("open_weight"),
    )
    level = (F.col("all") - F.col("capped")).cast("double") / F.col("open_weight")
    # The first source whose cap is not below the level ends the capping; its level holds for all that follow.
    first_open = F.min(F.when(F.col("cap") >= level * F.col("weight"), F.struct("capped", "open_weight"))).over(everything)
    held = (F.col("all") - first_open["capped"]).cast("double") / first_open["open_weight"]
    target = F.coalesce(F.least(F.col("cap").cast("double"), held * F.col("weight")), F.lit(0.0))
    return stepped.select("source", "source_size", "weight", target.alias("target"))


def offset_of(source: Column, seed: str = SEED) -> Column:
    """The offset of a source in [0, 1), from a digest of its name."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("\0")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 4294967296.0


def with_copies(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, slices: int = SLICES, seed: str = SEED
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of `docs` (doc_id, source, text)."""
    number = F.coalesce(F.col("doc_id"), F.lit(-1))
    sized = stored(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")))
    placed = sized.select(
        "*", size_step(F.col("size")).alias("step"), F.pmod(number, F.lit(slices)).cast("int").alias("slice")
    )
    counts = placed.groupBy("source", "step", "slice").agg(F.count("*").alias("n"))
    steps = counts.groupBy("source", "step").agg(F.sum("n").alias("n"))
    earlier = lambda *keys: W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
    steps = steps.select("source", "step", F.coalesce(F.sum("n").over(earlier("source", "step")), F.lit(0)).alias("steps_before"))
    targets = source_targets(sized, weights, most)
    starts = (
        counts.select("*", F.coalesce(F.sum("n").over(earlier("source", "step", "slice")), F.lit(0)).alias("slices_before"))
        .alias("c")
        .join(steps.alias("s"), F.expr("c.source <=> s.source AND c.step = s.step"))
        .join(targets.alias("t"), F.expr("c.source <=> t.source"))
        .select("c.source", "c.step", "c.slice", (F.col("slices_before") + F.col("steps_before")).alias("before"), "source_size", "target")
    )
    rank = F.row_number().over(W.partitionBy("p.source", "p.step", "p.slice").orderBy("p.doc_id", "p.size"))
    ranked = (
        placed.alias("p")
        .join(starts.alias("b"), F.expr("p.source <=> b.source AND p.step = b.step AND p.slice = b.slice"))
        .select("p.doc_id", "p.source", "p.size", "b.source_size", "b.target", (F.col("b.before") + rank).alias("place"))
    )
    offset = offset_of(F.col("source"), seed)
    crossed = lambda place: F.floor(offset + F.col("target") * place / F.col("source_size"))
    copies = F.when(F.col("size") > 0, F.least(F.lit(most), crossed(F.col("place")) - crossed(F.col("place") - 1)))
    return ranked.select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce(copies, F.lit(0)).cast("int").alias("copies")
    )


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed documents: every row of `docs` as often as the mix takes it.

    Copies are joined back on (doc_id, source, size), numbered where rows agree in all three.
    """
    counted = with_copies(docs, **settings).select("doc_id", "source", "size", "copies")
    keys = ("doc_id", "source", "size")
    sized = docs.select("*", F.size(words(F.col("text"))).cast("long").alias("__size"))
    totals = counted.groupBy(*keys).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    # Rows that agree in all keys share their copies evenly; the first ones get what is left over.
    one = totals.filter("__rows = 1 AND __copies > 0").alias("t")
    many = totals.filter("__rows > 1 AND __copies > 0").alias("t")
    on = F.expr("d.doc_id <=> t.doc_id AND d.source <=> t.source AND d.__size = t.size")
    nth = F.row_number().over(W.partitionBy("d.doc_id", "d.source", "d.__size").orderBy("d.text")) - 1
    share = F.floor(F.col("t.__copies") / F.col("t.__rows")) + (nth < F.col("t.__copies") % F.col("t.__rows")).cast("int")
    names = [F.col(f"d.`{c}`") for c in docs.columns]
    single = sized.alias("d").join(one, on).select(*names, F.col("t.__copies").alias("__n"))
    repeated = sized.alias("d").join(many, on).select(*names, share.alias("__n"))
    every = single.unionByName(repeated).filter("__n > 0")
    return every.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).drop("__n", "__i")
