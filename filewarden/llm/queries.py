"""Queries of the operators in this folder, each over its whole table, and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from filewarden.llm import sql
from filewarden.session import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf):
    from filewarden.llm.quality import COLUMNS, quality_rules

    names = [c for c in COLUMNS if c != "clean_text"]
    judged = quality_rules(_table(spark, sf, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[f"quality.{name}" for name in names])


def op2_embedding_dups(spark, sf):
    from filewarden.llm.embeddings import near_duplicates

    return near_duplicates(_table(spark, sf, "embeddings").select("vec_id", "embedding", "label"))


def op3_warc_revisits(spark, sf):
    from filewarden.llm.warc import archive

    records = archive(_table(spark, sf, "pages").select("page_id", "url", "html"), shared_folder(spark))
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op4_source_mix(spark, sf):
    from filewarden.llm.mixing import with_copies

    mixed = with_copies(_table(spark, sf, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_ngram_jaccard(spark, sf):
    from filewarden.llm.ngrams import near_copies

    return near_copies(_table(spark, sf, "documents").select("doc_id", "text"))


def op6_chat_format(spark, sf):
    from filewarden.llm.chat import format_turns, read_back

    said = "</s>[INST] ok [/INST]"
    columns = "conv_id bigint, turn bigint, role string, text string"
    extra = spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(-1), F.lit(i), F.lit(role), F.lit(said)) for i, role in enumerate(("user", "assistant"))]))
    )
    turns = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(turns.union(extra.toDF(*[c.split()[0] for c in columns.split(", ")]))))


def op7_bpe(spark, sf):
    import public_tokenizers
    from filewarden.llm.bpe import decode, encode

    path = public_tokenizers.path("word_bpe_49k.json")
    coded = decode(encode(_table(spark, sf, "documents").select("doc_id", "text"), path).drop("text"), path)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_line_dedup(spark, sf):
    from filewarden.llm.lines import dedup_lines

    kept = dedup_lines(_table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_license_scan(spark, sf):
    from filewarden.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf, "documents").select("doc_id", "text"))


def op10_substring_dedup(spark, sf):
    from filewarden.llm.substrings import drop_repeated

    kept = drop_repeated(_table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_ranked_search(spark, sf):
    from filewarden.llm.search import search

    return search(_table(spark, sf, "documents").select("doc_id", "text"), _table(spark, sf, "benchmark").select("item_id", "text"))


def op12_token_files(spark, sf):
    import public_tokenizers
    from filewarden.llm.direct import token_output

    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return token_output(docs, public_tokenizers.path("byte_bpe_50k.json"), shared_folder(spark))


def op13_hard_negatives(spark, sf):
    from filewarden.llm.negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf, "embeddings").select("vec_id", "embedding", moved.alias("label")))


def llm_queries():
    found = {name: value for name, value in globals().items() if name.startswith("op")}
    return {**found, "pipeline": corpus_pipeline.run}


def llm_oracles():
    known = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return known | {"op1_quality_rules": sql.OP1, "op3_warc_revisits": sql.OP3, "op4_source_mix": sql.OP4, "op6_chat_format": sql.OP6, "op8_line_dedup": sql.OP8, "op9_license_scan": sql.OP9, "op10_substring_dedup": sql.OP10, "op11_ranked_search": sql.OP11, "op13_hard_negatives": sql.OP13}
