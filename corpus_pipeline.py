"""A training-data pipeline over `documents`: clean, drop recurring lines, keep one of near copies, mix, encode.

Every stage takes the rows that the one before it kept and returns the columns of its input, the last one token ids.
Null ids, texts and sources, empty texts, repeated rows and empty tables are handled as the operators state: a text
without enough words is rejected by the first stage, which also drops repeated rows (same id and text); rows with a
null id are near copies of others like all rows and are kept only where no row of their group has an id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filewarden.llm.bpe import decode, encode
from filewarden.llm.lines import dedup_lines
from filewarden.llm.mixing import mix
from filewarden.llm.ngrams import near_copies
from filewarden.llm.quality import quality_rules
from filewarden.session import broadcast_if_small, stored

TOKENIZER = "word_bpe_49k.json"
ORACLE_SQL = None


def _with_text(docs: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """`columns` of `docs` with another text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return docs.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns])


def _key() -> Column:
    """A digest of id and text."""
    return F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit("")), F.col("doc_id").isNull())


def one_each(docs: DataFrame) -> DataFrame:
    """One row per id and text; of rows that differ in other columns, the first in their order.

    Repeated digests are found first, so that texts without repetition are not sorted and mostly not shuffled.
    """
    keyed = docs.withColumn("__key", _key())
    again = keyed.groupBy("__key").agg(F.count("*").alias("n")).filter("n > 1").select("__key")
    again = broadcast_if_small(stored(again))
    names = [F.col(f"`{c}`") for c in docs.columns]
    rest = F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])).alias("rest")
    repeated = keyed.join(again, "__key", "left_semi").groupBy("doc_id", "text").agg(rest).select("doc_id", "text", "rest.*")
    return keyed.join(again, "__key", "left_anti").select(*names).unionByName(repeated.select(*names))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, each once and without their failing lines."""
    judged = quality_rules(one_each(docs)).filter("quality.kept")
    return _with_text(judged, docs.columns, F.col("quality.clean_text"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of templates that recur across unrelated documents."""
    return _with_text(dedup_lines(docs), docs.columns, F.col("text"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the smallest id, of every group of near copies; a null id comes last."""
    # Rows are told apart by id and text, so rows that share only an id or have none are judged one by one.
    keyed = docs.withColumn("__key", _key())
    groups = near_copies(keyed.select(F.col("__key").alias("doc_id"), "text"))
    ids = keyed.select("__key", F.col("doc_id").isNull().alias("no_id"), "doc_id").distinct()
    member = groups.select(F.col("doc_id").alias("__key"), "component_id").distinct().join(ids, "__key")
    first = member.groupBy("component_id").agg(F.min(F.struct("no_id", "doc_id", "__key")).alias("first"))
    kept = first.select(F.col("first.__key").alias("__key"))
    return one_each(docs).withColumn("__key", _key()).join(kept, "__key", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of what they decode to."""
    path = public_tokenizers.path(TOKENIZER)
    coded = decode(encode(docs.select("doc_id", "lang", "source", "text"), path).drop("text"), path)
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", clean),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", keep_one),
    ("source_mix", mix_sources),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
