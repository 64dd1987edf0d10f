"""The corpus pipeline: every stage on what its predecessor kept, and odd tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindrel.llm import quality
from spindrel.llm.simhash import _prints
from spindrel.llm.tokens import Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __key long"
rng = random.Random(9)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
TOXIC = ["".join(rng.choice("qwxyz") for _ in range(6)) for _ in range(40)]
ITEM = " ".join(rng.choices(VOCABULARY, k=40))
LINES = "\n".join(" ".join(rng.choices(VOCABULARY, k=6)) for _ in range(4))


def prose(seed, n=90):
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    texts = [prose(k) for k in range(240)]
    for k in range(200, 240):  # toxic
        words = texts[k].split()
        words[20:40] = random.Random(k).choices(TOXIC, k=20)
        texts[k] = " ".join(words)
    for k in range(60, 70):
        texts[k] = texts[k - 60]  # copies
    for k in range(70, 75):
        texts[k] = texts[k - 60].replace(" ", " new ", 1)  # near copies
    for k in range(80, 84):
        texts[k] = f"{prose(k, 40)} {ITEM} {prose(k + 1000, 40)}"
    for k in range(90, 96):
        texts[k] = f"{prose(k, 40)}\n{LINES}\n{prose(k + 1000, 40)}"
    texts[96] = LINES  # all of it stands elsewhere before
    rows = [(k, t, "en", "web" if k % 3 else "books", len(t), 1) for k, t in enumerate(texts)] + [(240, None, None, None, None, 1), (241, "", "en", None, 0, 1), (None, prose(999), None, "web", None, 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k < 200), int(k >= 200)) for k in range(0, 240, 2)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def kept(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages, labels = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "mixing"]

    model = quality.train(*quality.labelled_sample(docs, labels))
    before = kept(docs)
    scores, _ = model.score(pa.array(list(before.values())))
    want = {i for i, s in zip(before, scores) if s[0] >= model.thresholds[0] and s[1] < model.thresholds[1]}
    accepted = stages["quality classifier"](spark, docs, folder)
    assert accepted.columns == docs.columns and set(kept(accepted)) == want
    assert not want & {240, 241} and len(want & set(range(200))) > 190 and len(want & set(range(200, 240))) < 3

    shortened = stages["line dedup"](spark, accepted, folder)
    seen, texts = set(), {}
    for i, t in sorted(kept(accepted).items(), key=lambda x: (x[0] is None, x[0])):
        lines = t.split("\n")
        full = [p for p, x in enumerate(lines) if x.strip()]
        gone = set()
        for a, b, c in zip(full, full[1:], full[2:]):
            window = tuple(lines[p].strip() for p in (a, b, c))
            gone |= {a, b, c} if window in seen else set()
            seen.add(window)
        if len(gone) < len(full):
            texts[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    assert shortened.columns == docs.columns and kept(shortened) == texts
    assert all(r.n_chars == len(r.text) for r in shortened.collect())
    assert LINES in texts[90] and LINES not in texts[91] and 96 not in texts

    single = stages["SimHash near-dedup"](spark, shortened, folder)
    ids = sorted(texts, key=lambda i: (i is None, i))
    prints = _prints(Words(pa.array([texts[i] for i in ids])), len(ids))
    near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= 40
    least = np.arange(len(ids))
    for _ in ids:
        least = np.array([least[near[i]].min() for i in range(len(ids))])
    texts = {i: texts[i] for n, i in enumerate(ids) if least[n] == n}
    assert single.columns == docs.columns and kept(single) == texts
    assert not set(texts) & set(range(60, 75))

    clean = stages["benchmark decontamination"](spark, single, folder)
    texts = {i: t for i, t in texts.items() if ITEM not in t}
    assert clean.columns == docs.columns and kept(clean) == texts and not set(texts) & set(range(80, 84))

    mixed = kept(stages["mixing"](spark, clean, folder))
    size = lambda x: sum(len(t.split()) for t in x.values())
    assert set(mixed) < set(texts) and all(texts[i] == t for i, t in mixed.items())
    assert abs(size(mixed) - 0.6 * size(texts)) < 4 * 95  # two units a source

    assert kept(corpus_pipeline.run(spark, folder)) == mixed


def test_stages_on_odd_and_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    nothing = docs.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]).limit(3)
    twice = docs.limit(5).unionByName(docs.limit(5))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        rows = stage(spark, nothing, folder).collect()
        # without a text: rejected; equal rows are one; a unit without tokens, so never drawn
        assert len(rows) == {"quality classifier": 0, "line dedup": 3, "SimHash near-dedup": 1, "benchmark decontamination": 3, "mixing": 0}[name], name
        out = stage(spark, twice, folder)
        assert out.columns == docs.columns
        counts = {r["count"] for r in out.groupBy("doc_id").count().collect()}
        assert counts <= ({1} if name == "SimHash near-dedup" else {2}), name
