"""The last gap of a source is filled until no remaining document fits."""

import pytest

from mlframe.llm import mix


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_error_is_below_the_smallest_remaining_document(spark, seed):
    # one source whose longest documents are far longer than a block, one of short documents, one of copies of a row
    rows = [(k, "s", "w " * (100 + k * 37 % 300)) for k in range(400)]
    rows += [(1000 + k, "s", "w " * 30_000) for k in range(4)]
    rows += [(2000 + k, "t", "w " * (1 + k % 50)) for k in range(300)]
    rows += [(3000 + k // 3, "u", "w " * (20 + k // 3)) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    plan, sources, n = mix.planned(docs, spec=mix.MixSpec(seed=seed, block_words=256))
    got = plan.collect()
    for s in sources.itertuples():
        of = [r for r in got if r.source == s.source]
        times = {}
        for r in of:
            words, draws = times.get(r.doc_id, (0, len(r[n.draws])))
            assert draws == len(r[n.draws]) <= s.target // s.source_size + 1
            times[r.doc_id] = (words + r[n.size], draws)
        short = s.target - sum(words * draws for words, draws in times.values())
        left = [words for words, draws in times.values() if draws < s.target // s.source_size + 1]
        assert 0 <= short and (not left or short < min(left))
