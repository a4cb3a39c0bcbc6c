"""Repeated runs of lines against a plain version over all pairs of neighbouring lines."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from mlframe.llm import linededup

SCHEMA = "doc_id long, text string"


def plain(rows):
    """{key: (text, lines removed)}: a line goes if a pair of neighbouring lines that it lies in stands earlier."""
    first, out = {}, {}
    for key, text in sorted(rows):
        if text is None:
            out[key] = (None, 0)
            continue
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\v\f\r")]
        gone = set()
        for no, (lo, hi) in enumerate(zip(full, full[1:])):
            where = first.setdefault("\n".join(lines[lo:hi + 1]), (key, no))
            if where != (key, no) and where != (key, no - 1):
                gone |= set(range(lo, hi + 1))
        out[key] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


def found(spark, rows):
    return {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_runs(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_planted_passages_go_to_their_ends(spark):
    for size in (2, 4, 6, 10, 20):
        passage = [f"shared {size} {i}" + "\n" * (i % 3 == 1 and i < size - 1) for i in range(size)]
        rows = [(k, "\n".join([f"own {k} a", *passage, f"own {k} b"])) for k in range(20)]
        docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], SCHEMA + ", n_chars long")
        out = {r.doc_id: (r.text, len(rows[r.doc_id][1]) - r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
        assert out[0] == (rows[0][1], 0)
        assert all(out[k][0] == f"own {k} a\nown {k} b" for k in range(1, 20))


def test_equals_plain_version(spark):
    r = random.Random(8)
    rows = [(k, "\n".join(r.choices(["a", "b", "c", "d", "", " ", f"own {k}", f"other {k}"], k=r.randint(1, 12)))) for k in range(300)]
    rows += [(300, None), (301, ""), (302, "x\nx\nx"), (303, "y\ny\ny\ny"), (304, " \n\n")]
    assert found(spark, rows) == plain(rows)
    assert linededup.dedup_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_rows_and_null_keys(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "b\nc")]
    out = linededup.dedup_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_removed) for r in out) == [(0, "b\nc", 0), (1, "a", 2), (1, "a", 2)]


def test_chunks_of_one_hash_are_told_apart_by_their_bytes(spark, monkeypatch):
    passage = "\n".join(f"line {i} of the shared passage" for i in range(12))
    rows = [(i, f"own {i} start\n{passage}\nown {i} end\nlast {i} line") for i in range(6)] + [(7, None), (8, ""), (9, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, linededup.dedup_lines(df).collect()), key=str)
    assert sum(r[-1] for r in want) > 0
    monkeypatch.setattr(linededup, "_digest", lambda chunk: F.length(chunk).cast("long") % 2)
    assert sorted(map(tuple, linededup.dedup_lines(df).collect()), key=str) == want


def test_pairs_move_without_their_texts(spark, monkeypatch):
    """What is stored and shuffled per pair is a digest, whatever the length of its lines."""
    stored, keep = {}, linededup.materialize
    monkeypatch.setattr(linededup, "materialize", lambda df, stem: stored.setdefault(stem, keep(df, stem)))
    long = "x" * 5000
    rows = [(k, f"own {k}\n{long} one\n{long} two\nend {k}") for k in range(30)]
    assert found(spark, rows) == plain(rows)
    for df in stored.values():
        assert not [f for f in df.schema.fields if f.dataType.simpleString() == "string"]
        assert max(len(str(r.asDict()).encode()) for r in df.collect()) < 1000
