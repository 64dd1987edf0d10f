"""Batch jobs, ticks, slices, logs, chat requests."""

import json

import pytest
from pyspark.sql import functions as F

from spindrel.operators import llm_json as L
from spindrel.sources import files as S
from spindrel.sources.services import Context, Fetcher, Models, Service, form_data, setting
from spindrel.streaming import jobs as J


def test_ticks_and_slices_keep_the_users_columns(spark):
    rows = spark.createDataFrame([(i, i % 7, "é" * (i % 5)) for i in range(100)], "id long, __part int, line string").withColumns({f"__{c}": F.lit(1) for c in ("place", "base", "n", "p", "i", "b", "m")})
    got = J.ticks(rows, ["id"], 30)
    assert got.columns == [*rows.columns, "tick"] and {(r.id, r.tick) for r in got.collect()} == {(i, i // 30) for i in range(100)}
    got, end = sorted(J.byte_slices(rows, ["id"], slice_bytes=16).collect(), key=lambda r: r.id), 0
    for r in got:
        begin, end = end, end + len(r.line.encode()) + 1
        assert (r.begin, r.end, r.slice) == (begin, end, (end - 1) // 16)
    assert J.ticks(rows.limit(0), ["id"]).count() == 0


def test_lines_are_read_by_slices(spark, tmp_path):
    data = "one\n\nzwölf\n" + "x" * 50 + "\n€€€€\nlast"
    (tmp_path / "out.jsonl").write_bytes(data.encode())
    for size in (1, 2, 3, 7, 16, 1000):
        cursor, lines, done, reads = J.Cursor(), [], False, 0
        while not done:
            more, cursor, done = J.read_lines(spark, f"file://{tmp_path}/out.jsonl", J.Cursor(cursor.pos, cursor.count), size)
            lines += more
            reads += 1
        assert lines == ["one", "zwölf", "x" * 50, "€€€€", "last"] and cursor == J.Cursor(len(data.encode()), 5)
        assert reads > 1 or size == 1000
    (tmp_path / "empty").write_bytes(b"")
    assert J.read_lines(spark, f"file://{tmp_path}/empty", J.Cursor()) == ([], J.Cursor(), True)


class Broken(J.Client):
    def build(self, job):
        return 1

    def upload(self, path):
        raise OSError("no route")


def test_a_step_that_throws_fails_the_job(spark):
    job = J.new_jobs(spark.createDataFrame([("j",)], "job_id string"), "/out/").first().asDict()
    assert job["input_path"] == "/out/j.input.jsonl" and job["completion_window"] == "24h"
    ended = J.run_job(job, Broken())
    assert (ended["status"], ended["reason"], ended["next_step"], ended["line_count"]) == ("failed", "error: no route", 1, 1)


def test_a_job_runs_to_its_end_and_waits_on_the_way(spark, tmp_path):
    lines = spark.createDataFrame([(i, json.dumps({"custom_id": str(i)})) for i in range(5)], "n long, line string")
    client = J.FolderClient(lines, ["n"], f"file://{tmp_path}/service", lambda x: x, per_tick=2, polls=1)
    job = J.new_jobs(spark.createDataFrame([("j",)], "job_id string"), f"file://{tmp_path}").first().asDict()
    slept = []
    first = J.run_job(job, client, until="batch:")
    assert first["reason"] == "batch:in_progress" and first["line_count"] == 5 and first["next_step"] == 3
    done = J.run_job(first, client, slept.append, 7.0)
    assert done["status"] == "done" and not slept  # it had ended by the next poll
    assert sorted(r.value for r in spark.read.text(J.output_path(done)).collect()) == sorted(r.line for r in lines.collect())
    assert done["error_file_id"] is None


def test_waiting_reasons(spark):
    rows = spark.createDataFrame([("completed",), ("Failed",), ("in_progress",), (None,)], "s string").select(J.waiting(F.col("s")).alias("r")).collect()
    assert [r.r for r in rows] == [None, None, "batch:in_progress", "batch:unknown"]


def test_output_lines_are_followed_and_logged(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"custom_id": "1", "response": {"body": "x"}}\n\nnot json')
    seen = []
    follow = lambda: J.for_each_line(J.tail_jsonl(spark, f"file://{tmp_path}/in"), lambda b, n: seen.extend(r.line for r in b.collect()), f"file://{tmp_path}/state")
    follow()
    (tmp_path / "in" / "b.jsonl").write_text("later\n")
    follow()
    assert sorted(seen) == ["later", "not json", '{"custom_id": "1", "response": {"body": "x"}}']
    messages = []
    spark.range(23).select(F.format_string("\u001b[31mline %d\u001b[0m", "id").alias("line"), F.when(F.col("id") < 2, "attn").otherwise("warn").alias("level")).coalesce(1).write.parquet(f"{tmp_path}/lines")
    J.append_log(spark.readStream.schema("line string, level string").parquet(f"{tmp_path}/lines"), f"{tmp_path}/log", f"{tmp_path}/log-state", messages.append, "info")
    assert sorted(map(len, messages)) == [1, 10, 10] and spark.read.text(f"{tmp_path}/log").count() == 21
    assert all("\u001b" not in x for m in messages for x in m)


def test_documents_become_json_lines(spark):
    rows = J.to_json_lines(spark.createDataFrame([(1, "a\nb")], "id long, doc string"), "id", "doc").collect()
    assert [json.loads(r.value) for r in rows] == [{"id": 1, "doc": "a\nb"}]


def test_prompts_take_their_fields(spark):
    one = spark.range(1)
    for kind, (system, user) in L.PROMPTS.items():
        names = set(__import__("re").findall(r"\{(\w+)\}", user))
        fields = {n: F.array(F.lit("q1"), F.lit("q2")) if n == "cluster" else F.lit(f"<{n}>") for n in names}
        got = one.select(L.prompt(kind, **fields).alias("p")).first().p
        assert got.system == system and "{" not in got.user and all(("1. q1\n2. q2" if n == "cluster" else f"<{n}>") in got.user for n in names)
    with pytest.raises(TypeError):
        L.prompt("snippet", content=F.lit("x"))


def test_replies_of_either_kind_are_parsed(spark):
    replies = [json.dumps({"message": {"content": '```json\n{"a": 1,}\n```'}}), json.dumps({"choices": [{"message": {"content": '{"a": 2'}}]}), json.dumps({"message": {"content": "no"}}), None]
    rows = spark.createDataFrame([(r,) for r in replies], "r string").select(L.parse_reply(F.col("r"), "a int").alias("x")).collect()
    assert [r.x and r.x.a for r in rows] == [1, 2, None, None]


def test_asking_tries_again(spark, tmp_path):
    count = tmp_path / "n"

    def send(prompt):
        n = int(count.read_text()) + 1 if count.exists() else 1
        count.write_text(str(n))
        return "broken" if n < 3 else '{"ok": true}'

    (row,) = L.ask(spark.createDataFrame([(1, "p")], "id long, prompt string"), send, tries=3).collect()
    assert (row.value, row.status, row.attempts) == ('{"ok": true}', "done", 3)


def test_embedding_failures_are_told(spark):
    def embed(texts):
        raise OSError("down")

    rows = L.embed_texts(spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string"), embed, retries=0).collect()
    assert {(r.id, r.embedding, r.status) for r in rows} == {(1, None, "retryExceeded"), (2, None, "retryExceeded")}


def test_settings_contexts_and_bound_services(spark, monkeypatch):
    monkeypatch.setenv("TOY_MODEL", "m")
    spark.conf.set("spark.spindrel.TOY_ENDPOINT", "http://e")
    context = Context.of("TOY", spark, timeout=3.0)
    assert context == Context("m", "http://e", "", 2, 3.0)
    with pytest.raises(KeyError):
        setting("TOY_NOTHING")
    service = Service(context, lambda c, p: json.dumps({"said": p, "by": c.model}), lambda c, t: [[float(len(x))] for x in t])
    rows = spark.createDataFrame([(1, "hey")], "id long, prompt string")
    assert json.loads(service.ask(rows).first().value) == {"said": "hey", "by": "m"}
    assert service.embed_texts(rows, text_col="prompt").first().embedding == [3.0]


def test_fetching_forms_and_models():
    f = Fetcher(lambda url, **o: ("application/json" if url.endswith("j") else "text/plain", b'{"a": 1}'))
    assert f.get("j") == {"a": 1} and f.get("t") == '{"a": 1}' and f.get("j", raw=True) == b'{"a": 1}' and f.get("t", parse_json=True, map_json=lambda x: x["a"]) == 1
    body = form_data({"purpose": "batch"}, "x.jsonl", b"data")
    assert b'name="purpose"\r\n\r\nbatch' in body and b'filename="x.jsonl"' in body and body.endswith(b"--spindrel-part--\r\n")
    made = []
    models = Models(lambda k: made.append(k) or k.upper())
    assert models.get("a") == models.get("a") == "A" and made == ["a"]
    models.clear()
    assert models.get("a") == "A" and made == ["a", "a"]


def test_local_payload_without_schema(spark):
    payload = json.loads(spark.range(1).select(L.local_payload(F.lit("s"), F.lit("u"), "m", schema_name="x")).first()[0])
    assert payload == {"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}], "stream": False}


def test_answers_that_exist(spark, tmp_path):
    d = f"file://{tmp_path}"
    (tmp_path / "q.json").write_text(json.dumps([{"q": 1}, {"q": 2}]))
    assert S.existing_answer_file(spark, f"{d}/q.jsonl", f"{d}/q.json", 3) is None
    assert S.existing_answer_file(spark, f"{d}/q.jsonl", f"{d}/q.json", 2).count() == 2
    (tmp_path / "q.json").unlink()
    assert sorted(json.loads(r.line)["q"] for r in S.existing_answer_file(spark, f"{d}/q.jsonl", f"{d}/q.json", 2).collect()) == [1, 2]


def test_a_tick_moves_its_lines_and_runs_no_job(spark, tmp_path):
    lines = spark.range(11).selectExpr("id AS n", "'line ' || id AS line")
    client = J.FolderClient(lines, ["n"], f"file://{tmp_path}/service", lambda x: x, per_tick=3)
    job = {"input_path": f"file://{tmp_path}/x.input.jsonl"}
    spark.sparkContext.setJobGroup("ticks", "")
    seen = [client.build(job) for _ in range(2)]
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("ticks") == []
    assert sorted(r.value for r in spark.read.text(job["input_path"]).collect()) == sorted(f"line {i}" for i in range(6))
    assert seen + [client.build(job) for _ in range(2)] == [None, None, None, 11]
    assert sorted(r.value for r in spark.read.text(job["input_path"]).collect()) == sorted(f"line {i}" for i in range(11))
    nothing = J.FolderClient(lines.limit(0), ["n"], f"file://{tmp_path}/none", lambda x: x)
    assert nothing.build({"input_path": f"file://{tmp_path}/none.jsonl"}) == 0 and spark.read.text(f"file://{tmp_path}/none.jsonl").count() == 0
    spark.sparkContext._jsc.clearJobGroup()


def test_an_embedder_gets_a_bounded_piece_at_once(spark):
    data = spark.range(7).selectExpr("id", "repeat('a', 400000) AS text").coalesce(1)
    rows = L.embed_texts(data, lambda texts: [[float(sum(map(len, texts)))]] * len(texts)).collect()
    assert sorted((r.id, r.status) for r in rows) == [(i, "done") for i in range(7)] and max(r.embedding[0] for r in rows) <= 1 << 20
