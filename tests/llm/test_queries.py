import zlib

import pytest

from quern.llm import oracles, queries
from tests.conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SMALL), duck.execute(oracles.ORACLES[name]))


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = queries.op5_langid(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["toxic"] == r["predicted"] for r in rows) >= 0.95 * len(rows)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_sentencepiece_round_trip(spark):
    rows = queries.op3_sentencepiece(spark, SMALL).collect()
    assert len(rows) == 200 and all(r["round_trip"] for r in rows)


def test_pipeline(spark):
    import corpus_pipeline as p

    out = p.run(spark, SMALL).collect()
    assert out and all(r["n_tokens"] == len(r["ids"]) for r in out)
    toxic = {r["doc_id"] for r in queries.op6_toxicity(spark, SMALL).where("predicted = 1").collect()}
    assert not toxic & {r["doc_id"] for r in out}
