"""A training-data pipeline over ``documents``: five stages, each written before the next reads it.

All stages: an empty table gives an empty one; very long texts are whole; columns beside those of
``documents`` are passed on whatever their names are, until the last stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import linededup, minhash, mixing, pieces, toxicity
from quern.llm.queries import toxicity_model
from quern.llm.spans import row_of, text_check
from quern.llm.store import documents, new_path, remove
from quern.plans.shared import scratch


def _held(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and all of them in a struct that they pass on."""
    return docs.select("doc_id", "text", row_of(docs.columns).alias("held"))


def _back(names: list[str], changed: dict[str, Column]) -> list[Column]:
    return [changed.get(c, F.col("held").getField(c)).alias(c) for c in names]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from those of ``docs`` with labels, doesn't reject.

    Null and empty texts stay unless the bias alone rejects them; without labels of both kinds all
    stay; rows without an id have no label and are scored like others; repeated rows share a fate."""
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(_held(docs), model).where("predicted = 0").select(*_back(docs.columns, {}))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that occur earlier; a text of which nothing is left goes.

    Null, empty and short texts stay as they are; n_chars follows the text; rows equal in id and
    text are one document and stay alike; ties go to the smaller id, then the smaller hash of the text."""
    out = linededup.dedup_lines(_held(docs)).where("n_removed = 0 or n_removed < n_lines")
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("held.n_chars"))}
    return out.select(*_back(docs.columns, {c: v for c, v in changed.items() if c in docs.columns}))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every group linked by a similarity of 0.8 of 5-word shingles.

    Null, empty and blank texts are linked with nothing and stay, as do rows without an id; rows
    that repeat both id and text are one document, of which one row stays; rows that share an id
    but not the text are kept or dropped together."""
    kept = minhash.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = _held(docs).withColumn("check", text_check(F.col("text"))).join(kept, "doc_id", "left_semi")
    # the join has dealt and sorted the rows by id already
    again = F.row_number().over(Window.partitionBy("doc_id", "check").orderBy(F.lit(0)))
    one = named.withColumn("again", again).where("again = 1").select(*_back(docs.columns, {}))
    return one.union(docs.where("doc_id is null").select(*[f"`{c}`" for c in docs.columns]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null and blank texts have no words and are drawn like others of their source; a null source is
    a source; rows without an id and repeated rows are drawn each for itself; ties in size go by id."""
    return mixing.emitted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with doc_id, lang and source.

    Null and empty texts have no tokens; equal texts have equal tokens."""
    return pieces.encoded(docs.select("doc_id", "lang", "source", "text"), pieces.load(spark)).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("near duplicates", drop_near_duplicates), ("mixing", mix_sources), ("sentencepiece", encode)]

#: Neither the learned scores nor the encoding can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote for itself goes at its end, its result when the next
    one has read it."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
