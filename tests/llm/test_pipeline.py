"""The stages on a small table, and the queries that have SQL."""

import hashlib
import json
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from chronotape.llm import byte_bpe
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        sizes.append(docs.count())
        texts = Counter(re.sub(r"[\x20\x09-\x0D]+", "", r["text"]) for r in docs.select("text").collect())
        if n in (1, 2):
            assert max(texts.values()) == 1
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.Ranks(path).ranks, special_tokens={})
    assert all(r["ids"] == library.encode_ordinary(r["text"]) for r in docs.collect())
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]


def run_stages(spark, docs, folder, sf):
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs


def test_chain_on_odd_rows_and_on_nothing(spark, table, odd_rows, clashing, tmp_path):
    """Nulls in every column, empty, blank and long texts, repeated rows, columns of the operators' own names."""
    sf = str(tmp_path)
    labels = [(i, int(i % 2 == 0), 0) for i, *_ in odd_rows if i is not None] + [(None, 1, None), (4, None, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    clashing(table(odd_rows + odd_rows[:6])).write.parquet(f"{sf}/odd.parquet")
    docs = spark.read.parquet(f"{sf}/odd.parquet")
    out = run_stages(spark, docs, f"{sf}/out", sf)
    assert out.columns == [*docs.columns, "_ids", "decoded_sha256"]
    known = {r["text"] for r in docs.select("text").collect()}
    rows = out.collect()
    assert all(r["text"] in known and r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in rows)
    docs.limit(0).write.parquet(f"{sf}/none.parquet")
    assert run_stages(spark, spark.read.parquet(f"{sf}/none.parquet"), f"{sf}/empty", sf).count() == 0


def test_every_operator_has_a_query():
    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_query_equals_sql(spark, name):
    message = compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name])
    assert message is None, message


def test_good_documents_pass_the_classifier(spark):
    scored = entry.queries()["op1_quality_classifier"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").select("quality", "predicted").collect()
    assert len(rows) > 50
    right = sum(r["quality"] == r["predicted"] for r in rows) / len(rows)
    assert right >= 0.9, json.dumps(right)
