"""What Python workers keep and get at a time."""

import weakref

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from mlframe.llm import bpe, common, langid
from mlframe.llm.queries import tokenizer_file


@pytest.fixture
def default_batches(spark):
    before = spark.conf.get(common.ARROW_ROWS)
    spark.conf.set(common.ARROW_ROWS, 10_000)
    yield
    spark.conf.set(common.ARROW_ROWS, before)


def test_a_worker_holds_one_model():
    samples = (("de", "der die das und"), ("en", "the and that with"))
    parser = langid.parser(samples)
    assert langid.parser(samples) is parser
    parser = weakref.ref(parser)
    codec = bpe.codec(tokenizer_file())
    assert bpe.codec(tokenizer_file()) is codec and parser() is None
    codec.encode("some words")
    ref, codec = weakref.ref(codec), None
    langid.parser(samples)
    assert ref() is None


@pytest.mark.parametrize("name", ["language", "near_duplicates", "encoding"])
def test_stages_hand_small_batches_to_workers(spark, default_batches, name):
    docs = spark.createDataFrame([(1, "a", "en", "some words of a text", 20)], "doc_id long, source string, lang string, text string, n_chars long")
    dict(corpus_pipeline.STAGES)[name](spark, docs, "")

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    sizes = [r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(rows, "n long").collect()]
    assert sum(sizes) == 5000 and max(sizes) <= common.BATCH_ROWS


def test_a_smaller_setting_stays(spark, default_batches):
    spark.conf.set(common.ARROW_ROWS, 100)
    common.small_batches(spark)
    assert spark.conf.get(common.ARROW_ROWS) == "100"
    spark.conf.set(common.ARROW_ROWS, 0)  # no bound
    common.small_batches(spark)
    assert spark.conf.get(common.ARROW_ROWS) == str(common.BATCH_ROWS)


def test_workers_return_what_arrow_frees():
    pool = pa.default_memory_pool()
    data = pa.array(np.zeros(1 << 20))
    del data
    common.release()
    assert pool.bytes_allocated() < 8 << 20
