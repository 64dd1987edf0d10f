"""Files and folders, JSON lines, HTML, vectors."""

import math

import pytest
from pyspark.sql import functions as F

from spindrel.functions.vectors import cosine_first, pooled
from spindrel.operators import cluster as K
from spindrel.operators.chunk import ChunkOptions, chunk_documents
from spindrel.operators.html_text import html_to_text, links, plain_text
from spindrel.sources import files as S
from spindrel.sources.tables import kept, shared_folder


@pytest.fixture
def folder(tmp_path):
    for name, text in {"one.md": "# One", "one.md.jsonl": '{"a": 1}\n\n{"a": 2}\n', "two.txt": "two\nlines", "Three.MD": "x", "bad.jsonl": '{"a": 1}\nnot json\n', "array.json": '[{"a": 1}, {"a": 2}]'}.items():
        (tmp_path / name).write_text(text)
    return tmp_path


def test_texts_and_listings(spark, folder):
    texts = {r["name"]: r.text for r in S.read_texts(spark, f"{folder}/*.md").collect()}
    assert texts == {"one.md": "# One"}
    assert {r["name"] for r in S.list_files(spark, str(folder), [".md"]).collect()} == {"one.md", "Three.MD"}
    assert S.list_files(spark, str(folder)).count() == 6
    S.write_texts(spark.createDataFrame([("a",), ("b",)], "text string"), f"{folder}/out")
    assert sorted(r.value for r in spark.read.text(f"{folder}/out").collect()) == ["a", "b"]


def test_json_lines(spark, folder):
    assert sorted(r.a for r in S.read_jsonl(spark, f"{folder}/one.md.jsonl", "a int").collect()) == [1, 2]
    assert S.read_jsonl(spark, f"{folder}/one.md.jsonl").count() == 2
    with pytest.raises(Exception, match="MALFORMED"):
        S.read_jsonl(spark, f"{folder}/bad.jsonl", "a int").collect()
    S.json_array_to_jsonl(spark, f"{folder}/array.json", f"{folder}/array")
    assert sorted(r.a for r in S.read_jsonl(spark, f"{folder}/array.jsonl", "a int").collect()) == [1, 2]


def test_pairs_of_a_folder(spark, folder):
    names = S.list_files(spark, str(folder)).select("name", S.base_name(F.col("name")).alias("base"))
    content, lines = names.where(~F.col("name").endswith(".jsonl")), names.where(F.col("name").endswith(".jsonl"))
    assert [(r["name"], r.jsonl_name) for r in S.pair_outputs(content, lines).collect()] == [("one.md", "one.md.jsonl")]
    assert {r["name"] for r in S.unpaired(content, lines).collect()} == {"two.txt", "Three.MD", "array.json"}


def test_bytes_and_paths(spark, folder):
    path = f"file://{folder}/deep/er/data.bin"
    assert S.ensure_folder(spark, f"file://{folder}/deep/er")
    assert S.write_bytes(spark, path, [b"\x00\xff", b"", b"more" * 1000]) == 4002
    assert b"".join(S.read_bytes(spark, path, 1024)) == b"\x00\xff" + b"more" * 1000
    assert S.copy_path(spark, path, path + ".copy") and S.path_exists(spark, path + ".copy")
    assert S.remove_path(spark, path) and not S.path_exists(spark, path) and S.remove_path(spark, path)

    def breaks():
        yield b"some"
        raise OSError("cut off")

    with pytest.raises(OSError):
        S.write_bytes(spark, path, breaks())
    assert not S.path_exists(spark, path)


def test_html_as_browsers_read_it(spark):
    page = "<div><p>caf&eacute; &#8217;n&#x27; 3 < 4</p><script>var a = '<p>no</p>';</script><a class='c' href='/u'>x</a> <a href=/v>y</a><br>z&nbsp;&nbsp;!</div>"
    assert plain_text(page) == "café ’n' 3 < 4\nx y\nz !"
    rows = spark.createDataFrame([(1, page), (2, "plain 3 < 4 &amp;"), (3, None), (4, ""), (5, "<html><body>b</body></html>")], "id long, html string")
    got = {r.id: (r.t, r.u, r.l) for r in rows.select("id", html_to_text(F.col("html")).alias("t"), html_to_text(F.col("html"), True).alias("u"), links(F.col("html")).alias("l")).collect()}
    assert got[1] == (plain_text(page), plain_text(page), ["/u", "/v"])
    assert got[2] == ("plain 3 < 4 &amp;", "plain 3 < 4 &amp;", []) and got[3] == (None, None, None) and got[4] == ("", "", [])
    assert got[5][:2] == ("<html><body>b</body></html>", "b")


def test_vectors(spark):
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0, 5.0]), ([1.0, 0.0], [1.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in v.select(cosine_first(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - math.sqrt(0.5)) < 1e-12 and math.isnan(got[1]) and got[2] == 0
    t = spark.createDataFrame([([[3.0, 0.0], [0.0, 4.0]],), ([],), (None,)], "t array<array<double>>")
    assert [r[0] for r in t.select(pooled(F.col("t"))).collect()] == [[1.5, 2.0], None, None]
    assert [r[0] for r in t.select(pooled(F.col("t"), "max", True)).collect()][0] == [0.6, 0.8]
    assert [r[0] for r in t.select(pooled(F.col("t"), "cls")).collect()][0] == [3.0, 0.0]


def test_references_without_a_semicolon_stay():
    assert plain_text("<p>a &amp; b&amp</p><p>&lt;i&gt; &copy &#39 &ampfoo; &amp;lt; &nope; &Eacute;</p>") == "a & b&amp\n<i> &copy &#39 &ampfoo; &lt; &nope; É"


@pytest.mark.parametrize("block", [1024, 4])
def test_all_pairs_by_tiles(spark, block):
    import random

    r = random.Random(2)
    rows = [(i, [float(r.randint(-3, 3)) for _ in range(3 if i % 5 else 2)]) for i in range(23)] + [(30, [0.0, 0.0, 0.0]), (31, None), (None, [1.0])]

    def cosine(a, b):
        n = min(len(a), len(b))
        norm = math.sqrt(sum(x * x for x in a[:n]) * sum(x * x for x in b[:n]))
        return round(sum(x * y for x, y in zip(a, b)) / norm, 6) if norm else 0.0

    data = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, tile int, side int")
    full = {(i, j): cosine(a, b) for i, a in rows for j, b in rows if i is not None and j is not None and i < j and a and b}
    assert {(x.i, x.j): round(x.sim, 6) + 0.0 for x in K.cosine_pairs(data, block=block).collect()} == full
    assert {(x.i, x.j) for x in K.cosine_pairs(data, 0.5, block=block).collect()} == {p for p, sim in full.items() if sim >= 0.5}
    assert K.cosine_pairs(data.limit(0)).count() == 0


def _vectors(spark, seed=5):
    """Close and far ones, of either length, equal ids, zeros and nulls, in any order."""
    import random

    r = random.Random(seed)
    rows = [(r.randint(0, 60), [float(r.randint(-3, 3)) for _ in range(4 if r.random() < 0.8 else 2)]) for _ in range(70)]
    rows += [(61, [0.0] * 4), (62, None), (5, None), (None, [1.0] * 4), (63, [-5.0, 1e-200, 0.0, 1.0])]
    return rows, spark.createDataFrame(rows, "vec_id int, embedding array<double>")


def _close(a, b, tau):
    n = min(len(a), len(b))
    norm = math.sqrt(sum(x * x for x in a[:n]) * sum(x * x for x in b[:n]))
    return (round(sum(x * y for x, y in zip(a, b)) / norm, 6) if norm else 0.0) >= tau


@pytest.mark.parametrize("tau", [0.7, 0.0])
@pytest.mark.parametrize("chunk", [9, 65536])
def test_pairs_and_clusters_by_chunks(spark, monkeypatch, chunk, tau):
    rows, data = _vectors(spark)
    want = sorted((i, j) for i, a in rows for j, b in rows if i is not None and j is not None and i < j and a and b and _close(a, b, tau))
    pairs = K.cosine_pairs(data, tau, block=4, chunk=chunk)
    assert sorted((x.i, x.j) for x in pairs.collect()) == want
    # vectors are not dealt out to every tile: what multiplies reads the table
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()

    monkeypatch.setattr(K, "cosine_pairs", None)  # clusters don't make the pairs
    leader: dict[int, int] = {}
    met = {*want, *((j, i) for i, j in want)}
    for i in sorted({i for i, _ in rows if i is not None}):
        leader[i] = next((j for j in sorted(leader) if leader[j] == j and (i, j) in met), i)
    got = K.group_similar(data, tau, block=4, chunk=chunk)
    assert sorted((x.vec_id, x.leader) for x in got.collect()) == sorted(leader.items()) and got.dtypes == [("vec_id", "int"), ("leader", "int")]
    assert K.group_similar(data.limit(0)).count() == 0


def test_texts_are_projected_and_grouped(spark):
    items = spark.createDataFrame([(1, "aab"), (2, "aabb"), (3, "zz"), (4, "z")], "id long, name string")
    embed = lambda texts: [[t.count("a"), t.count("b"), t.count("z")] for t in texts]
    got = {r.leader: r["items"] for r in K.project_and_group(items, F.upper("name"), lambda t: embed([x.lower() for x in t]), 0.7).collect()}
    assert got == {1: ["AAB", "AABB"], 3: ["ZZ", "Z"]}


def test_classes_of_items_and_ties(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None)], "vec_id long, embedding array<double>")
    labels = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [0.0, 1.0])], "label string, centroid array<double>")
    assert {(r.vec_id, r.category) for r in K.classify(items.where("embedding is not null"), labels).collect()} == {(1, "b"), (2, "a")}


def test_chunks_keep_columns_and_wait_no_longer_than_told(spark):
    import time

    def slow(texts):
        time.sleep(0.5)
        return [[1.0]] * len(texts)

    docs = spark.createDataFrame([(1, "One. Two. Three. Four.", None, "t"), (2, None, "en", "u")], "doc_id long, text string, lang string, chunks string")
    got = {r.doc_id: r for r in chunk_documents(docs, embed=slow, timeout=0.05, keep=("lang", "chunks")).collect()}
    assert (got[1].status, got[1].chunks, got[1].lang, got[1]["chunks_"]) == ("timeout", None, None, "t") and (got[2].status, got[2].lang) == ("empty", "en")
    rescued = chunk_documents(docs, embed=slow, timeout=0.05, rescue=True).where("doc_id = 1").first()
    assert rescued.chunks == ["One. Two. Three. Four."]


def test_markdown_chunks_of_documents(spark):
    text = "# A\n\n" + "word " * 100 + "\n\n# B\n\n" + "other " * 100 + "\n\n# C\n\n" + "third " * 100
    (row,) = chunk_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), ChunkOptions(markdown=True, min_chars=10)).collect()
    assert row.status == "done" and "# A" in row.chunks[0] and "third" in row.chunks[-1]


class Session:
    """What shared_folder() asks of a session."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master = master


def test_the_shared_folder_is_that_of_the_session(spark):
    assert shared_folder(Session("file:///x/shared/", "yarn")) == "file:///x/shared"
    with pytest.raises(ValueError):
        shared_folder(Session(None, "spark://host:7077"))
    assert kept(spark.range(3)).count() == 3
