"""The registered text queries on the smallest tables, against SQL or plain versions over all rows."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from check_queries import compare, connect
from tokenizers import Tokenizer

import corpus_pipeline
from mlframe.llm.queries import ORACLES, QUERIES, tokenizer_file

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table():
    return duckdb.sql(f"SELECT * FROM '{FOLDER}/documents.parquet'").df()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op7_topk", "op12_whiten"}))
def test_one_row_per_document(spark, table, name):
    assert sorted(r.doc_id for r in QUERIES[name](spark, FOLDER).collect()) == sorted(table.doc_id)


def test_token_digests(spark, table):
    library, at = Tokenizer.from_file(tokenizer_file()), 0
    files = {r.doc_id: r for r in QUERIES["op8_token_files"](spark, FOLDER).collect()}
    coded = {r.doc_id: r for r in QUERIES["op9_bpe"](spark, FOLDER).collect()}
    for r in table.sort_values("doc_id").itertuples():
        ids = library.encode(r.text, add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert coded[r.doc_id].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert (files[r.doc_id].start, files[r.doc_id].ids_crc32) == (at, zlib.crc32(raw + np.array([2], "<u4").tobytes()))
        at += len(ids) + 1


def test_top_k_query(spark):
    v = duckdb.sql(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet' ORDER BY vec_id").df()
    fixed = np.floor(np.array(v.embedding.tolist(), np.float64) * 1024).astype(np.int64)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in QUERIES["op7_topk"](spark, FOLDER).collect()}
    ids = v.vec_id.tolist()
    for q in [i for i, k in enumerate(ids) if k % 100 == 0]:
        order = sorted((-int(s), ids[i]) for i, s in enumerate(fixed @ fixed[q]) if i != q)[:10]
        assert [got[(ids[q], k + 1)] for k in range(10)] == [(i, -s) for s, i in order]


def test_pipeline(spark, table):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, FOLDER)
        assert at.columns == docs.columns, name
        if name == "near_duplicates":
            ids = [r.doc_id for r in at.collect()]
            assert len(ids) == len(set(ids)) and set(ids) <= set(table.doc_id)
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"] and out.count() > 100
