"""Behaviours of chunking, folds and repair on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrel.functions import text as T
from spindrel.functions.replies import parse, sanitize
from spindrel.operators.chunk import ChunkOptions, chunk_documents, chunk_segments, distances, fold, letter_embed, threshold
from spindrel.operators.cluster import greedy_clusters


def test_fold_cuts_at_the_limit_but_never_at_the_last_gap():
    o = ChunkOptions(min_chars=0, max_chars=math.inf)
    assert fold(["S1.", "S2.", "S3.", "S4."], [0.9, 0.1, 0.1], 0.9, o) == ["S1.\nS2.", "S2.\nS3.\nS4."]
    assert fold(["a", "b", "c"], [0.1, 0.9], 0.9, o) == ["a\nb\nc"]


def test_short_tail_goes_unless_kept():
    segments, gaps = ["x" * 300, "y" * 300, "z", "z"], [1.0, 0.0, 0.0]
    assert len(fold(segments, gaps, 1.0, ChunkOptions(overlap=0))) == 1
    assert len(fold(segments, gaps, 1.0, ChunkOptions(overlap=0, keep_tail=True))) == 2


def test_threshold_is_a_rank_and_nan_distances_go():
    assert threshold([0.75, 0.1, 0.2, 0.3, 1.0], 90) == 0.75
    assert math.isnan(threshold([], 90))
    assert distances(np.array([[1.0, 0.0], [0.0, 1.0], [math.nan, 1.0], [0.0, 0.0], [0.0, 1.0]])) == [1.0, 1.0]


def test_few_segments_and_letters():
    assert chunk_segments(["only"], letter_embed, ChunkOptions()) == ["only"]
    assert letter_embed(["abca", ""]).sum(1).tolist() == [4.0, 0.0]


def test_chunks_of_nulls_short_and_failing_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "Short."), (3, "One two. Three four. Five six. Seven.")], "doc_id long, text string")
    got = {r.doc_id: (r.chunks, r.status) for r in chunk_documents(docs).collect()}
    assert got[1] == (None, "empty") and got[2] == (["Short."], "done") and got[3][1] == "done"

    def broken(texts):
        raise OSError

    failed = {r.doc_id: (r.chunks, r.status) for r in chunk_documents(docs, embed=broken, rescue=True).collect()}
    assert failed[3] == (["One two. Three four. Five six. Seven."], "retryExceeded")


def test_columns(spark):
    row = spark.range(1).select(
        T.preprocess(F.lit("a\r\n\nb - x  well- \nknown")).alias("pre"), T.sentences(F.lit("A. B. C. D.")).alias("one"), T.sentences(F.lit("Hello world.  This is a test!")).alias("two"),
        T.companion_path(F.lit("/x/y.md"), "jsonl").alias("path"), T.sanitize_json(F.lit('```json\n{"a": [1,],\n```')).alias("json"), T.lower_rank(F.array(*[F.lit(x) for x in (3.0, 1.0, 2.0)]), 90).alias("rank"),
    ).first()
    assert row.pre == "a b - x well-known" and row.one == ["A. B. C. D."] and len(row.two) == 2
    assert row.path == "/x/y_qa.jsonl" and row.rank == 2.0


@pytest.mark.parametrize("reply, value", [('```json\n{"a": [1, 2,],}\n```', {"a": [1, 2]}), ('{"a": 1', {"a": 1}), ("[1,2]", [1, 2])])
def test_replies(reply, value):
    assert parse(reply) == value
    assert sanitize("[1]", "always") == "[1]}"


@pytest.mark.parametrize("together", [2_000_000, 0])
def test_greedy_clusters_follow_the_sequential_walk(spark, together):
    rng = np.random.default_rng(3)
    edges = sorted({tuple(sorted(map(int, p))) for p in rng.integers(0, 30, (40, 2)) if p[0] != p[1]} | {(2, 9)})
    leader: dict[int, int] = {}
    for i in range(30):
        if i not in leader:
            leader |= {j: i for j in range(i, 30) if j not in leader and (j == i or (i, j) in edges)}
    got = greedy_clusters(spark.range(30).withColumnRenamed("id", "vec_id"), spark.createDataFrame([*edges, (3, 3), (9, 2)], "i long, j long"), together=together)
    assert {r.vec_id: r.leader for r in got.collect()} == leader


def test_upper_case_by_character(spark):
    import duckdb

    texts = ["straße ŉ ﬁ ᾳ ǆ", "plain äöü ı", "", None, *(chr(c) for c in range(1, 0x2000) if len(chr(c).upper()) > 1)]
    data = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.u for r in data.select("id", T.upper_by_char(F.col("t")).alias("u")).collect()}
    assert got == {i: t and duckdb.execute("SELECT upper(?)", [t]).fetchone()[0] for i, t in enumerate(texts)}
