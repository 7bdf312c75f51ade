"""The registered queries of this package: thin forms of its operators, whole tables each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import fingerprints, langid, linededup, minhash, mixing, mpegts, pieces, substrings, toxicity, warc
from quern.llm.exprs import crc_of_id
from quern.llm.store import documents, new_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k sketches of whole texts and of their edited texts, with estimated likeness."""
    out = fingerprints.edited_fingerprints(documents(spark, sf_dir))
    text = fingerprints.as_text
    return out.select("doc_id", "n_chars", "edited_sha256", text(F.col("sketch")).alias("fingerprint"), text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without their later repeated lines."""
    out = linededup.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts encoded to token ids and decoded again."""
    model = pieces.load(spark)
    tokens = pieces.encoded(documents(spark, sf_dir).select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")), model)
    out = pieces.decoded(tokens, model)
    back = F.sha2("decoded", 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), pieces.ids_digest(F.col("ids")).alias("ids_sha256"), back.alias("decoded_sha256"), (back == F.col("text_sha256")).alias("round_trip"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives with revisit records and read back."""
    path = new_path(spark, "warc")
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    out = warc.rejoin(warc.read(spark, path, payloads=False))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, from prototypes of those that are not held out."""
    docs = documents(spark, sf_dir).withColumn("held_out", F.pmod(crc_of_id(F.col("doc_id")), F.lit(3)) == 1)
    model = langid.prototypes(docs.where("not held_out and lang is not null").select("doc_id", "text", "lang"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.train(docs, labels.where(F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) != 0))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, by a model of the labels that are not held out."""
    docs = documents(spark, sf_dir).withColumn("held_out", F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) == 0)
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.score(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of 2-word shingle sets at a similarity of 0.8."""
    return minhash.near_duplicates(documents(spark, sf_dir), size=2, percent=80)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of sources to target weights takes."""
    out = mixing.mixed(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts stored as MPEG transport streams, read back and measured."""
    out = mpegts.from_media(mpegts.to_media(documents(spark, sf_dir)))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "points")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without repeated spans of sentences."""
    out = substrings.dedup_spans(documents(spark, sf_dir))
    return out.select("doc_id", "n_sentences", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_fingerprints, op2_line_dedup, op3_sentencepiece, op4_warc, op5_langid, op6_toxicity, op7_minhash, op8_mixing, op9_mpegts, op10_substrings)
}
