"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitgauge.llm import conversation_repair, filter_audit, line_chunks, token_codes, mixing, quality_rules
from commitgauge.llm.common import computed, read_table, shared_folder, stored
from commitgauge.llm.language_model import language_scores
from commitgauge.llm.minhash_dedup import near_duplicates
from commitgauge.llm.neighbours import search
from commitgauge.llm.packing import pack
from commitgauge.llm.secret_scan import scan
from commitgauge.llm.token_counts import Rollups, counts
from commitgauge.llm.toxicity import toxicity
from commitgauge.operators.joins import hot_join


def _fold(n: int):
    """Remainder of crc32 of the id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality(read_table(spark, sf_dir, "documents"))
    return found.withColumn("clean_md5", F.md5("clean_text")).drop("clean_text")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_scores(read_table(spark, sf_dir, "documents"), F.coalesce(_fold(5) != 1, F.lit(True)))
    return scored.withColumn("held_out", F.coalesce(_fold(5) == 1, F.lit(False)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four commits: all documents in, exact copies out, German counts revised, and the copies replayed."""
    docs = read_table(spark, sf_dir, "documents")
    rows = stored(counts(docs), "tokens-counts")
    texts = stored(docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("t")).filter("t is not null"), "tokens-texts")
    copy_of = texts.groupBy("t").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copy_of = stored(copy_of, "tokens-copies")
    gone = hot_join(texts, copy_of.drop("n"), "t", ["doc_id"], copy_of, texts.count()).filter("doc_id <> first")
    gone = gone.select("doc_id", F.lit("delete").alias("op"), *(F.lit(None).cast(t).alias(c) for c, t in (
        ("source", "string"), ("lang", "string"), ("tokenizer", "string"), ("n_tokens", "long"))))
    revised = rows.filter("lang = 'de' and tokenizer = 'words-2'").withColumn("tokenizer", F.lit("words-1"))
    revised = revised.join(gone.select("doc_id"), "doc_id", "left_anti").withColumn("op", F.lit("revise"))
    store = Rollups(spark, f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}")
    store.commit("1-all", rows.withColumn("op", F.lit("insert")))
    store.commit("2-copies", gone)
    store.commit("3-german", revised)
    store.commit("2-copies", gone)
    return store.totals()


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_chunks.repeated_passages(read_table(spark, sf_dir, "documents"))
    left = line_chunks.without(F.col("text"), F.col("removed"))
    found = computed(found, "doc_id", "text", "removed", left=left)
    lines = F.aggregate("removed", F.lit(0).cast("long"), lambda n, c: n + c["length"])
    return found.select(
        "doc_id",
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("removed_chunks"),
        lines.alias("removed_lines"),
        F.length("left").cast("long").alias("chars_left"),
        F.md5("left").alias("clean_md5"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), _fold(3) != 1
    )
    return scored.withColumn("held_out", F.coalesce(_fold(3) == 1, F.lit(False)))


def finding_label() -> Column:
    """The tables hold no findings with a verdict. These are labelled by their form: a provider's prefix, or a value
    without a dictionary word that is assigned to the name of a credential, is a secret; digits alone are not, nor is
    what has neither such a name near nor such a prefix."""
    return (
        F.when((F.col("known_prefix") == 1) & (F.col("length") >= 16), 1.0)
        .when((F.col("credential_near") == 1) & (F.col("assigned") == 1) & (F.col("coverage") < 0.5), 1.0)
        .when(F.col("digit_share") == 1, 0.0)
        .when(F.col("credential_near") == 0, 0.0)
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"), finding_label(), F.coalesce(_fold(3) != 1, F.lit(True)))
    return found.withColumn("value_md5", F.md5("value")).drop("value")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(read_table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written as directly addressable codes, and every document read back from them."""
    path = f"{shared_folder(spark)}/token-codes-{uuid.uuid4().hex}"
    return token_codes.read_codes(token_codes.write_codes(read_table(spark, sf_dir, "documents"), path))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_dedup, op2_quality_rules, op3_language_model, op4_mixing, op5_token_counts, op6_line_dedup,
        op7_toxicity, op8_secret_scan, op9_packing, op10_neighbours, op11_conversation_repair, op12_filter_audit,
        op13_token_codes,
    )
}
