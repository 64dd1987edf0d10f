"""Registered queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import cosine
from ..operators import chunk as C
from ..operators import cluster as K
from ..operators import html_text as H
from ..operators import llm_json as L
from ..operators import markdown as M
from ..sources import files as S
from ..sources.tables import shared_folder
from ..streaming import jobs as J
from . import pipeline as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Pieces of SQL that several oracles share. \x01 marks sentence ends, \x02 the space after an abbreviation.
_PRE = r"regexp_replace(regexp_replace(regexp_replace(text, '\r?\n+', ' ', 'g'), '(?i)([a-z])([–-])\s+([a-z])', '\1\2\3', 'g'), '\s+', ' ', 'g')"
_GUARD = rf"regexp_replace(regexp_replace({_PRE}, '(^|[ \x02])([A-Z][.]) ', '\1\2' || chr(2), 'g'), '(^|[ \x02])([A-Z][.]) ', '\1\2' || chr(2), 'g')"
_SENT = rf"list_filter(list_transform(string_split(regexp_replace({_GUARD}, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(replace(s, chr(2), ' '))), lambda s: s <> '')"
_LETTERS = "[" + ", ".join(f"CAST(length(lower(w)) - length(replace(lower(w), '{c}', '')) AS DOUBLE)" for c in "abcdefghijklmnopqrstuvwxyz") + "]"
_SEGS = f"segs AS (SELECT doc_id, lang, text, {_SENT} AS s FROM documents)"
_WINS = "wins AS (SELECT doc_id, unnest(range(0, len(s) - 1)) AS pos, unnest(list_transform(range(0, len(s) - 1), lambda i: s[i + 1] || ' ' || s[i + 2])) AS w FROM segs WHERE len(s) >= 2)"
_VECS = f"vecs AS (SELECT doc_id, pos, {_LETTERS} AS v FROM wins)"
_DIST = """dist AS (
    SELECT doc_id, pos - 1 AS pos, round(1 - CASE WHEN list_dot_product(a, a) * list_dot_product(v, v) = 0 THEN 0 ELSE list_dot_product(a, v) / sqrt(list_dot_product(a, a) * list_dot_product(v, v)) END, 6) AS distance
    FROM (SELECT doc_id, pos, v, lag(v) OVER (PARTITION BY doc_id ORDER BY pos) AS a FROM vecs) WHERE a IS NOT NULL
)"""
_THR = "thr AS (SELECT doc_id, list(distance ORDER BY pos) AS d, list_sort(list(distance))[CAST(floor(0.9 * (count(*) - 1)) AS INTEGER) + 1] AS t FROM dist GROUP BY doc_id)"
_CHUNKS = f"""
    WITH RECURSIVE {_SEGS}, {_WINS}, {_VECS}, {_DIST}, {_THR},
    base AS (SELECT doc_id, text, s, d, t, coalesce(len(d), 0) AS m FROM segs LEFT JOIN thr USING (doc_id)),
    go AS (
        SELECT doc_id, 0 AS i, 0 AS start, CAST(NULL AS VARCHAR) AS chunk, 0 AS n FROM base WHERE len(s) > 2 AND m > 0
        UNION ALL
        SELECT doc_id, i + 1, CASE WHEN cut THEN greatest(i + 1, start + 1) ELSE start END, CASE WHEN cut THEN part END, n + CAST(cut AS INTEGER)
        FROM (
            SELECT *, (d[i + 1] >= t OR length(part) > 2000) AND length(part) >= 300 AS cut
            FROM (SELECT g.doc_id, i, start, n, d, t, m, array_to_string(s[start + 1:i + 2], chr(10)) AS part FROM go g JOIN base USING (doc_id) WHERE i + 1 < m)
        )
    ),
    last AS (SELECT doc_id, max_by(start, i) AS start, max_by(n, i) AS n, max(i) AS i FROM go GROUP BY doc_id),
    tail AS (SELECT doc_id, n AS pos, array_to_string(s[start + 1:], chr(10)) AS chunk, n FROM last JOIN base USING (doc_id) WHERE start < len(s)),
    chunks AS (
        SELECT doc_id, CAST(n - 1 AS BIGINT) AS pos, chunk FROM go WHERE chunk IS NOT NULL
        UNION ALL SELECT doc_id, pos, chunk FROM tail WHERE length(chunk) >= 300 OR n = 0
        UNION ALL SELECT doc_id, 0, text FROM base WHERE len(s) <= 2
    )
"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "text", T.sentences(T.preprocess(F.col("text")), True).alias("s"))


@query(f"SELECT doc_id, {_PRE} AS text FROM documents")
def preprocess_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.preprocess(F.col("text")).alias("text"))


@query(f"WITH {_SEGS} SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS sentence FROM segs")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("doc_id", F.posexplode("s").alias("pos", "sentence"))


@query(f"WITH {_SEGS}, {_WINS} SELECT doc_id, pos, w AS win FROM wins")
def sentence_windows(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("doc_id", F.posexplode(T.windows(F.col("s"), 2)).alias("pos", "win"))


@query(f"WITH {_SEGS} SELECT doc_id, len(s) AS n, array_to_string(s, chr(10)) AS joined FROM segs WHERE len(s) <= 2")
def few_segment_docs(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).where(F.size("s") <= 2).select("doc_id", F.size("s").alias("n"), F.get(T.guard_few(F.col("s"), 2), F.lit(0)).alias("joined"))


@query("SELECT doc_id, 0 AS pos, text AS chunk FROM documents")
def identity_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.array("text")).alias("pos", "chunk"))


@query(f"SELECT doc_id, {_LETTERS.replace('(w)', '(text)')} AS v FROM documents")
def letter_embedding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.letter_counts(F.col("text")).alias("v"))


def _distances(spark: SparkSession, d: str) -> DataFrame:
    return C.window_gaps(table(spark, d, "documents"), digits=6)


@query(f"WITH {_SEGS}, {_WINS}, {_VECS}, {_DIST} SELECT doc_id, pos, distance FROM dist")
def window_distances(spark: SparkSession, d: str) -> DataFrame:
    return _distances(spark, d).select("doc_id", F.posexplode("d").alias("pos", "distance"))


@query(f"WITH {_SEGS}, {_WINS}, {_VECS}, {_DIST}, {_THR} SELECT doc_id, t AS threshold FROM thr")
def break_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _distances(spark, d).select("doc_id", T.lower_rank(F.col("d"), 90).alias("threshold"))


@query(_CHUNKS + "SELECT doc_id, pos, chunk FROM chunks")
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.exploded(C.chunk_documents(table(spark, d, "documents"), digits=6))


@query(_CHUNKS + "SELECT lang, count(*) AS chunks, count(DISTINCT doc_id) AS docs, CAST(sum(length(chunk)) AS BIGINT) AS chars FROM chunks JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang")
def chunk_stats_by_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    sizes = C.chunk_documents(docs, digits=6, keep=("lang",)).select("lang", F.size("chunks").alias("n"), F.aggregate("chunks", F.lit(0).cast("long"), lambda s, c: s + F.length(c)).alias("chars"))
    return sizes.groupBy("lang").agg(F.sum("n").cast("long").alias("chunks"), F.count("*").alias("docs"), F.sum("chars").alias("chars"))


_SIM = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_EDGES = f"edges AS (SELECT a.vec_id AS i, b.vec_id AS j, {_SIM} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round({_SIM}, 6) >= 0.3)"
_GREEDY = f"""
    WITH RECURSIVE {_EDGES}, both_ways AS (SELECT i AS u, j AS v FROM edges UNION ALL SELECT j, i FROM edges),
    ordered AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings),
    near AS (SELECT o.r, list(b.v) AS vs FROM ordered o LEFT JOIN both_ways b ON b.u = o.vec_id AND b.v < o.vec_id GROUP BY o.r),
    walk AS (
        SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS leaders
        UNION ALL
        SELECT o.r, CASE WHEN list_has_any(w.leaders, coalesce(n.vs, [])) THEN w.leaders ELSE list_append(w.leaders, o.vec_id) END
        FROM walk w JOIN ordered o ON o.r = w.r + 1 JOIN near n ON n.r = o.r
    ),
    leaders AS (SELECT unnest(max_by(leaders, r)) AS leader FROM walk),
    clusters AS (
        SELECT leader AS vec_id, leader FROM leaders
        UNION ALL SELECT u, min(leader) FROM both_ways JOIN leaders ON v = leader WHERE u NOT IN (SELECT leader FROM leaders) GROUP BY u
    )
"""


@query(f"SELECT a.vec_id AS i, b.vec_id AS j, round({_SIM}, 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return K.cosine_pairs(table(spark, d, "embeddings")).select("i", "j", F.round("sim", 6).alias("sim"))


@query(f"WITH {_EDGES} SELECT i, j, round(sim, 6) AS sim FROM edges")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return K.cosine_pairs(table(spark, d, "embeddings"), 0.3).select("i", "j", F.round("sim", 6).alias("sim"))


@query(_GREEDY + "SELECT vec_id, leader FROM clusters")
def greedy_clusters(spark: SparkSession, d: str) -> DataFrame:
    return K.group_similar(table(spark, d, "embeddings"), 0.3)


@query(_GREEDY + "SELECT leader, count(*) AS n, list(vec_id ORDER BY vec_id) AS members FROM clusters GROUP BY leader")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return K.group_similar(table(spark, d, "embeddings"), 0.3).groupBy("leader").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("vec_id")).alias("members"))


_CLASSIFY = """
    WITH cells AS (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS k FROM embeddings),
    means AS (SELECT label, k, round(avg(CAST(x AS DOUBLE)), 9) AS x FROM cells GROUP BY label, k),
    protos AS (SELECT label, list(x ORDER BY k) AS c FROM means GROUP BY label),
    scored AS (SELECT vec_id, p.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 6) AS score FROM embeddings, protos p),
    classified AS (SELECT vec_id, label AS category, score FROM scored QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1)
"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return K.classify(v, K.prototypes(v))


@query(_CLASSIFY + "SELECT vec_id, category, score FROM classified")
def classify_prototype(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d)


@query(_CLASSIFY + "SELECT category, list(vec_id ORDER BY vec_id) AS items FROM classified GROUP BY category")
def group_by_category(spark: SparkSession, d: str) -> DataFrame:
    return K.group_by_category(_classified(spark, d), "vec_id")


@query(_CLASSIFY + "SELECT category, count(*) AS n FROM (SELECT category FROM classified UNION ALL SELECT label FROM embeddings) GROUP BY category")
def classify_sources(spark: SparkSession, d: str) -> DataFrame:
    """Results of two sources, accumulated by category."""
    given = table(spark, d, "embeddings").select(F.col("label").alias("category"))
    return _classified(spark, d).select("category").unionByName(given).groupBy("category").agg(F.count("*").alias("n"))


def _pipeline() -> P.Pipeline:
    return (
        P.Pipeline()
        .add("clean", lambda x: F.regexp_replace(x, "\n", " "))
        .add("accept", lambda x: x, lambda x: F.when(F.length(x) < 200, "too short"))
        .add("quiet", F.lower)
        .add("turn", F.reverse)
    )


_STATE = "CASE WHEN length(text) < 200 THEN"


@query(f"SELECT doc_id, {_STATE} replace(text, chr(10), ' ') ELSE reverse(lower(replace(text, chr(10), ' '))) END AS doc, {_STATE} 'paused' ELSE 'done' END AS status, {_STATE} 'too short' END AS reason, {_STATE} 1 ELSE 4 END AS next_step FROM documents")
def pipeline_run(spark: SparkSession, d: str) -> DataFrame:
    p = _pipeline()
    return p.run(p.start(table(spark, d, "documents").select("doc_id", "text"), F.col("text"))).drop("text")


@query(
    """
    WITH c AS (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)
    SELECT doc_id, 0 AS step, 'progress' AS type, t AS doc, NULL AS reason, 1 AS next_step FROM c
    UNION ALL SELECT doc_id, 1, CASE WHEN length(t) < 200 THEN 'pause' ELSE 'progress' END, t, CASE WHEN length(t) < 200 THEN 'too short' END, CASE WHEN length(t) < 200 THEN 1 ELSE 2 END FROM c
    UNION ALL SELECT doc_id, 2, 'progress', lower(t), NULL, 3 FROM c WHERE length(t) >= 200
    UNION ALL SELECT doc_id, 3, 'progress', reverse(lower(t)), NULL, 4 FROM c WHERE length(t) >= 200
"""
)
def pipeline_events(spark: SparkSession, d: str) -> DataFrame:
    p = _pipeline()
    return p.events(p.start(table(spark, d, "documents").select("doc_id", "text"), F.col("text"))).drop("text", "name")


@query("SELECT doc_id, CASE WHEN length(text) < 200 THEN reverse(upper(text)) ELSE reverse(text) END AS doc FROM documents")
def pipeline_resume(spark: SparkSession, d: str) -> DataFrame:
    """Paused documents go on by a second pipeline, whose steps are its own."""
    p = P.Pipeline().add("accept", lambda x: x, lambda x: F.when(F.length(x) < 200, "too short")).add("turn", F.reverse)
    q = P.Pipeline().add("shout", T.upper_by_char).add("turn", F.reverse)
    ran = p.run(p.start(table(spark, d, "documents").select("doc_id", "text"), F.col("text")))
    return q.run(q.resumed(ran).withColumn("next_step", F.lit(0))).select("doc_id", "doc")


@query(
    """
    SELECT doc_id, CASE WHEN length(a) <= 500 THEN a WHEN length(b) <= 500 THEN b ELSE reverse(b) END AS doc
    FROM (SELECT doc_id, trim(text) AS a, regexp_replace(trim(text), '[aeiou ]', '', 'g') AS b FROM documents)
"""
)
def sequence_stop(spark: SparkSession, d: str) -> DataFrame:
    steps = P.with_sequence(F.trim, lambda x: F.regexp_replace(x, "[aeiou ]", ""), F.reverse, stop=lambda x: F.length(x) <= 500)
    return table(spark, d, "documents").select("doc_id", steps(F.col("text")).alias("doc"))


@query("SELECT event_id, CASE WHEN event_type LIKE 'c%' THEN upper(event_type) WHEN length(event_type) > 6 THEN upper(event_type) || '!' ELSE upper(event_type) || '!?' END AS doc FROM events")
def alternatives(spark: SparkSession, d: str) -> DataFrame:
    """Each strategy goes on from the one before's result."""
    accept = lambda x: x.like("C%") | (x.like("%!") & (F.length(x) > 7))
    tried = P.with_alternatives(F.upper, lambda x: F.concat(x, F.lit("!")), lambda x: F.concat(x, F.lit("?")), accept=accept)
    return table(spark, d, "events").select("event_id", tried(F.col("event_type")).alias("doc"))


def _flaky(doc: str) -> P.Outcome:
    if doc.startswith("p"):
        raise ValueError(doc)
    return P.Outcome(reason="skip", payload=doc) if doc.startswith("v") else P.Outcome(doc.upper())


@query(
    """
    SELECT event_id, CASE WHEN event_type[1] IN ('p', 'v') THEN event_type ELSE upper(event_type) END AS doc, CASE WHEN event_type[1] IN ('p', 'v') THEN 'paused' ELSE 'done' END AS status,
        CASE event_type[1] WHEN 'p' THEN 'retryExceeded' WHEN 'v' THEN 'skip' END AS reason, CASE WHEN event_type[1] = 'p' THEN 3 ELSE 1 END AS attempts
    FROM events
"""
)
def retry_outcomes(spark: SparkSession, d: str) -> DataFrame:
    step = P.with_retry(P.with_error_handling(_flaky), 2)
    return P.run_python(table(spark, d, "events"), [step], "event_id", "event_type").drop("step")


@query("SELECT event_id, upper(event_type) || ':' || length(event_type) AS made FROM events")
def cached_step(spark: SparkSession, d: str) -> DataFrame:
    made = lambda keys: keys.select("key", F.concat(F.upper("key"), F.lit(":"), F.length("key").cast("string")).alias("made"))
    return P.cached(table(spark, d, "events"), F.col("event_type"), made, "made").select("event_id", "made")


@query("SELECT event_id, user_id, event_type, value FROM events")
def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSON lines to the shared folder and read again."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    path = S.save_jsonl(e, f"{shared_folder(spark)}/events-{uuid.uuid4().hex}")
    return S.read_jsonl(spark, path, "event_id bigint, user_id bigint, event_type string, value double")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def jsonl_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "string").alias("k"))


@query("SELECT doc_id, quality, toxic, length(text) AS n FROM documents JOIN labels USING (doc_id)")
def pair_content_labels(spark: SparkSession, d: str) -> DataFrame:
    return S.pair_outputs(table(spark, d, "documents").select("doc_id", F.length("text").alias("n")), table(spark, d, "labels"), "doc_id", "quality")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def missing_labels(spark: SparkSession, d: str) -> DataFrame:
    return S.unpaired(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query(
    """
    WITH c AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL HAVING count(*) >= 2)
    SELECT conv_id, CASE WHEN bool_or(role = 'assistant') THEN 'jsonl' ELSE 'json' END AS source, CASE WHEN bool_or(role = 'assistant') THEN max(n) FILTER (role = 'assistant') ELSE max(n) END AS n
    FROM c WHERE role IN ('assistant', 'user') GROUP BY conv_id
"""
)
def existing_qa(spark: SparkSession, d: str) -> DataFrame:
    """Assistants' turns stand for the answers of the first kind, users' for those of the second."""
    c = table(spark, d, "conversations")
    return S.existing_answers(c.where("role = 'assistant'"), c.where("role = 'user'"), 2, "conv_id").select("conv_id", F.col("source"), "n")


@query(
    """
    SELECT conv_id AS identifier, text AS content, list(line ORDER BY turn) AS json_data
    FROM (SELECT conv_id, text FROM conversations WHERE turn = 0) JOIN (SELECT conv_id, turn, role || ':' || length(text) AS line FROM conversations WHERE turn > 0) USING (conv_id) GROUP BY ALL
"""
)
def process_parsed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    lines = c.where("turn > 0").select("conv_id", F.col("turn").alias("pos"), F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("line"))
    return S.process_parsed(c.where("turn = 0").select("conv_id", "text"), lines, "conv_id")


@query(
    """
    SELECT page_id, regexp_replace(url, '[^/]*$', '') || CASE WHEN stem = '' THEN 'unknown' ELSE stem END || '_qa.jsonl' AS path, ends_with(lower(url), '1') OR ends_with(lower(url), 'top') AS matches
    FROM (SELECT page_id, url, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1') AS stem FROM pages)
"""
)
def answer_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.companion_path(F.col("url"), "jsonl").alias("path"), T.has_extension(F.col("url"), ["1", "top"]).alias("matches"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(value AS VARCHAR) IS NOT NULL AS ok FROM events")
def sanitize_llm_json(spark: SparkSession, d: str) -> DataFrame:
    """Properties as a model would send them: in a fence, with a trailing comma and without the last brace."""
    sent = F.concat(F.lit("```json\n"), F.regexp_replace("props", r"\}\s*$", ",\n"), F.lit("\n```"))
    broken = F.regexp_replace(sent, r",\n\n```$", "\n```")
    return table(spark, d, "events").select("event_id", F.get_json_object(T.sanitize_json(broken), "$.k").alias("k"), F.col("value").isNotNull().alias("ok"))


@query(
    """
    SELECT conv_id, turn, json_extract_string(line, '$.custom_id') AS custom_id, json_extract_string(line, '$.body.model') AS model, json_extract_string(line, '$.body.messages[1].content') AS content,
        json_extract_string(line, '$.body.max_tokens') AS max_tokens, json_extract_string(line, '$.method') || json_extract_string(line, '$.url') AS target
    FROM (SELECT conv_id, turn, json_object('custom_id', 'c' || conv_id || '-' || turn, 'method', 'POST', 'url', '/v1/chat/completions',
        'body', json_object('model', 'gpt-4o-mini', 'max_tokens', 1000, 'messages', [json_object('role', 'system', 'content', role), json_object('role', 'user', 'content', text)])) AS line FROM conversations)
"""
)
def batch_lines(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    line = L.batch_line(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn"), F.col("role"), F.col("text"))
    get = lambda p: F.get_json_object("line", p)
    return c.withColumn("line", line).select(
        "conv_id", "turn", get("$.custom_id").alias("custom_id"), get("$.body.model").alias("model"), get("$.body.messages[1].content").alias("content"), get("$.body.max_tokens").alias("max_tokens"), F.concat(get("$.method"), get("$.url")).alias("target")
    )


@query("SELECT conv_id, turn, CAST(floor((row_number() OVER (ORDER BY conv_id, turn) - 1) / 100) AS BIGINT) AS tick FROM conversations")
def batch_ticks(spark: SparkSession, d: str) -> DataFrame:
    return J.ticks(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], 100)


@query(
    """
    SELECT conv_id, turn, CAST(e - size AS BIGINT) AS begin, CAST(e AS BIGINT) AS end, CAST(floor((e - 1) / 512) AS BIGINT) AS slice
    FROM (SELECT conv_id, turn, octet_length(encode(text)) + 1 AS size, sum(octet_length(encode(text)) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations)
"""
)
def batch_slices(spark: SparkSession, d: str) -> DataFrame:
    """A conversation is a file, a turn a line."""
    return J.byte_slices(table(spark, d, "conversations"), ["turn"], "text", 512, ["conv_id"]).select("conv_id", "turn", "begin", "end", "slice")


_RESULTS = "results AS (SELECT 'c' || conv_id AS custom_id, max_by(text, turn) AS value FROM conversations WHERE role <> 'user' GROUP BY conv_id)"


def _results(spark: SparkSession, d: str) -> DataFrame:
    body = F.struct(F.col("text").alias("body"))
    error = F.when(F.col("role") == "user", F.lit("failed"))
    line = F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("custom_id"), error.alias("error"), body.alias("response")))
    return L.batch_results(table(spark, d, "conversations").select(line.alias("line"), F.col("turn").alias("pos")))


@query(f"WITH {_RESULTS} SELECT * FROM results")
def batch_results(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d)


@query(f"WITH {_RESULTS} SELECT * FROM results WHERE custom_id IN (SELECT 'c' || doc_id FROM labels)")
def batch_poll(spark: SparkSession, d: str) -> DataFrame:
    return L.poll(_results(spark, d), table(spark, d, "labels").select(F.concat(F.lit("c"), "doc_id").alias("custom_id")))


@query("SELECT conv_id, turn, role <> 'user' AS ok, CASE WHEN role <> 'user' THEN text END AS body, CASE WHEN role = 'user' THEN 'failed' END AS error FROM conversations")
def parsed_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.to_json(F.struct(F.col("conv_id").cast("string").alias("custom_id"), F.when(F.col("role") == "user", "failed").alias("error"), F.when(F.col("role") != "user", F.struct(F.col("text").alias("body"))).alias("response")))
    return table(spark, d, "conversations").select("conv_id", "turn", J.parse_line(line).alias("p")).select("conv_id", "turn", "p.ok", "p.body", "p.error")


@query(_GREEDY + "SELECT leader, 'Name what these share:' || chr(10) || string_agg(r || '. ' || vec_id, chr(10) ORDER BY r) AS prompt FROM (SELECT leader, vec_id, row_number() OVER (PARTITION BY leader ORDER BY vec_id) AS r FROM clusters) GROUP BY leader")
def prompt_numbered_list(spark: SparkSession, d: str) -> DataFrame:
    groups = K.group_similar(table(spark, d, "embeddings"), 0.3).groupBy("leader").agg(F.array_sort(F.collect_list("vec_id")).cast("array<string>").alias("items"))
    return groups.select("leader", L.numbered_prompt(F.col("items"), "Name what these share:").alias("prompt"))


@query("SELECT conv_id, turn, 'You condense documents.' AS system, 'Write a short summary of this text:' || chr(10) || text AS user FROM conversations")
def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", L.prompt("summary", content=F.col("text")).alias("p")).select("conv_id", "turn", "p.*")


@query(
    """
    SELECT c.conv_id, 'Write one question that covers all of these:' || chr(10) || string_agg(r || '. ' || text, chr(10) ORDER BY r) || chr(10) || chr(10) || 'They are about this text:' || chr(10) || any_value(t.first) AS user
    FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user') c JOIN (SELECT conv_id, min_by(text, turn) AS first FROM conversations GROUP BY conv_id) t USING (conv_id) GROUP BY c.conv_id
"""
)
def prompt_single_question(spark: SparkSession, d: str) -> DataFrame:
    """What a conversation's user asked, as one numbered list, with its first turn as context."""
    c = table(spark, d, "conversations")
    asked = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda x: x["text"])
    by = c.groupBy("conv_id").agg(asked.alias("cluster"), F.min_by("text", "turn").alias("context")).where(F.size("cluster") > 0)
    return by.select("conv_id", L.prompt("single_question", cluster=F.col("cluster"), context=F.col("context"))["user"].alias("user"))


@query(
    """
    SELECT batch, count(*) AS n, string_agg('[' || event_type || '] ' || props, chr(10) ORDER BY event_id) AS message
    FROM (SELECT *, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 10) AS BIGINT) AS batch FROM events) GROUP BY batch
"""
)
def log_batches_of_10(spark: SparkSession, d: str) -> DataFrame:
    coloured = table(spark, d, "events").withColumn("props", F.concat(F.lit("\u001b[31m"), "props", F.lit("\u001b[0m")))
    return J.log_batches(coloured, ["event_id"], "event_type", "props")


@query("SELECT page_id, regexp_matches(html, '^<(?:!DOCTYPE html><)?[a-z]') AND NOT regexp_matches(html, '^(<!DOCTYPE html>)?<html') AS fragment FROM pages")
def html_is_fragment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", H.is_fragment(F.col("html")).alias("fragment"))


#: By splitting at every <: what stands before the next > is a tag, the rest text.
_SHOWN = r"regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->|<!doctype[^>]*>', '', 'g')"
_TAG = "lower(regexp_extract(p, '^/?[a-zA-Z0-9]+'))"
_ENDS = "[" + ", ".join(f"'/{t}'" for t in "p div h1 h2 h3 h4 h5 h6 li tr ul ol table nav article section footer header blockquote pre".split()) + ", 'br']"
_HTML_TEXT = f"array_to_string(list_transform(list_transform(string_split('>' || {_SHOWN}, '<'), lambda p: CASE WHEN list_contains({_ENDS}, {_TAG}) THEN chr(10) ELSE '' END || substr(p, strpos(p, '>') + 1)), lambda t: t), '')"
for _entity, _mark in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&amp;", "'&'")):
    _HTML_TEXT = f"replace({_HTML_TEXT}, '{_entity}', {_mark})"
_HTML_TEXT = rf"regexp_replace(regexp_replace(regexp_replace({_HTML_TEXT}, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


@query(f"SELECT page_id, {_HTML_TEXT} AS text FROM pages")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", H.html_to_text(F.col("html"), unwrap_html=True).alias("text"))


@query("SELECT page_id, html AS text FROM pages")
def html_to_text_as_given(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents aren't fragments and stay."""
    return table(spark, d, "pages").select("page_id", H.html_to_text(F.col("html")).alias("text"))


@query(
    """
    SELECT page_id, list_sort(list_distinct(list_filter(list_transform(list_filter(string_split(html, '<'), lambda p: lower(p) LIKE 'a %'), lambda p: string_split(split_part(p, 'href="', 2), chr(34))[1]), lambda x: x <> ''))) AS links
    FROM pages
"""
)
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.array_sort(H.links(F.col("html"))).alias("links"))


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    """One Markdown text per conversation: turns under their roles, users' at the first level; the whole
    text as paragraph, list, quote, table or code in turn (escaped where marks would count), and a line after it."""
    c = table(spark, d, "conversations")
    words = F.trim(F.regexp_replace(F.regexp_replace("text", r"([!-/:-@\[-`{-~])", r"\\$1"), r"\n+", " "))
    kind = F.col("turn") % 5
    block = (
        F.when(kind == 0, words)
        .when(kind == 1, F.concat(F.lit("- "), "role", F.lit("\n- "), words))
        .when(kind == 2, F.concat(F.lit("> "), words))
        .when(kind == 3, F.concat(F.lit("| role | words |\n| --- | --- |\n| "), "role", F.lit(" | "), words, F.lit(" |")))
        .otherwise(F.concat(F.lit("```\n"), "text", F.lit("\n```")))
    )
    part = F.concat(F.when(F.col("role") == "user", F.lit("# ")).otherwise(F.lit("## ")), F.initcap("role"), F.lit("\n\n"), block, F.lit("\n\nn"), "turn")
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("md"))


_MD = r"""
    texts AS (SELECT conv_id, turn, role, text, trim(regexp_replace(text, '\n+', ' ', 'g')) AS t, (CASE WHEN role = 'user' THEN '# ' ELSE '## ' END) || upper(role[1]) || lower(role[2:]) AS head, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
    parts AS (
        SELECT *, ['paragraph', 'list', 'quote', 'table', 'code'][turn % 5 + 1] AS kind, 'n' || turn AS tiny, CASE turn % 5 WHEN 0 THEN t WHEN 1 THEN '- ' || role || chr(10) || '- ' || t WHEN 2 THEN '> ' || t
            WHEN 3 THEN 'role | words' || chr(10) || '--- | ---' || chr(10) || role || ' | ' || t ELSE '```' || chr(10) || array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10)) || chr(10) || '```' END AS block
        FROM texts
    ), user_heads AS (SELECT *, max(CASE WHEN role = 'user' THEN r END) OVER (PARTITION BY conv_id ORDER BY r) AS u FROM parts),
    paths AS (SELECT *, CASE WHEN role = 'user' THEN ['# User'] WHEN u IS NOT NULL THEN ['# User', head] ELSE [head] END AS path FROM user_heads)
"""


@query(
    "WITH "
    + _MD
    + """
    , rows AS (SELECT conv_id, r, 0 AS k, 'heading' AS type, head AS text, path FROM paths UNION ALL SELECT conv_id, r, 1, kind, block, path FROM paths UNION ALL SELECT conv_id, r, 2, 'paragraph', tiny, path FROM paths)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY r, k) - 1 AS pos, type, text, path AS header_path FROM rows
"""
)
def markdown_segments(spark: SparkSession, d: str) -> DataFrame:
    return M.markdown_segments(_markdown(spark, d), "conv_id", "md")


_RUNS = (
    "WITH "
    + _MD
    + """
    , marked AS (SELECT *, CASE WHEN lag(path) OVER w IS DISTINCT FROM path THEN 1 ELSE 0 END AS opens FROM paths WINDOW w AS (PARTITION BY conv_id ORDER BY r)),
    runs AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY conv_id ORDER BY r) AS BIGINT) AS run FROM marked)
"""
)


@query(_RUNS + "SELECT conv_id, run, string_agg(head || chr(10) || chr(10) || block || chr(10) || chr(10) || tiny, chr(10) || chr(10) ORDER BY r) AS text, any_value(path) AS header_path FROM runs GROUP BY conv_id, run")
def markdown_groups(spark: SparkSession, d: str) -> DataFrame:
    return M.header_runs(M.markdown_segments(_markdown(spark, d), "conv_id", "md"), "conv_id")


@query(_RUNS + "SELECT conv_id, run - 1 AS pos, string_agg(head || chr(10) || chr(10) || block || chr(10) || tiny, chr(10) || chr(10) ORDER BY r) AS text, any_value(path) AS header_path FROM runs GROUP BY conv_id, run")
def markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Tiny blocks join the one before them."""
    return M.markdown_chunks(_markdown(spark, d), id_col="conv_id", text_col="md").select("conv_id", "pos", "text", "header_path")


@query(
    _RUNS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """
    , turns AS (SELECT conv_id, r, path, head || chr(10) || chr(10) || block || chr(10) || tiny AS t, max(r) OVER (PARTITION BY conv_id) AS n FROM runs),
    go AS (
        SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS r, '' AS carry, CAST(NULL AS VARCHAR) AS made, CAST(NULL AS VARCHAR[]) AS path FROM turns
        UNION ALL
        SELECT conv_id, r, CASE WHEN length(x) < 300 AND r < n THEN x || chr(10) || chr(10) ELSE '' END, CASE WHEN length(x) >= 300 OR r = n THEN x END, path
        FROM (SELECT t.conv_id, t.r, t.n, t.path, g.carry || t.t AS x FROM go g JOIN turns t ON t.conv_id = g.conv_id AND t.r = g.r + 1)
    ),
    made AS (SELECT *, length(made) < 300 AND lag(path) OVER w IS NOT DISTINCT FROM path AND lag(path) OVER w IS NOT NULL AS joins FROM go WHERE made IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY r)),
    ends AS (SELECT *, CASE WHEN lead(joins) OVER w THEN chr(10) || chr(10) || lead(made) OVER w ELSE '' END AS tail FROM made WINDOW w AS (PARTITION BY conv_id ORDER BY r)),
    cut AS (SELECT conv_id, r, path, made, tail, unnest(range(0, CASE WHEN length(made) >= 2000 THEN length(made) ELSE 1 END, 2000)) AS k FROM ends WHERE NOT joins)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY r, k) - 1 AS pos, substr(made, CAST(k + 1 AS BIGINT), 2000) || CASE WHEN k + 2000 >= length(made) THEN tail ELSE '' END AS text, path AS header_path FROM cut
"""
)
def markdown_bounds(spark: SparkSession, d: str) -> DataFrame:
    return M.markdown_chunks(_markdown(spark, d), 300, 2000, True, "conv_id", "md").select("conv_id", "pos", "text", "header_path")


def _setext(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    body = F.regexp_replace("text", r"\n+", " ")
    part = F.concat(F.lit("Turn "), "turn", F.lit(" "), F.col("role"), F.lit("\n-----\n"), body)
    return c.groupBy("conv_id").agg(F.concat(F.lit("URL Source\nMarkdown Content:\nopening words\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("t")))), lambda x: x["t"]), "\n")).alias("md"))


@query(
    """
    SELECT conv_id, 'turn-' || turn || '-' || role AS slug, 'Turn ' || turn || ' ' || role AS header, trim(regexp_replace(text, '\\n+', ' ', 'g')) AS body FROM conversations
    UNION ALL SELECT DISTINCT conv_id, 'breaking-news', 'Breaking News', 'opening words' || chr(10) FROM conversations
"""
)
def setext_sections(spark: SparkSession, d: str) -> DataFrame:
    s = _setext(spark, d).select("conv_id", F.explode(M.sections(F.col("md"))).alias("s")).select("conv_id", "s.*")
    return s.withColumn("body", F.when(F.col("slug") == "breaking-news", F.concat(F.regexp_replace("body", r"\n+$", ""), F.lit("\n"))).otherwise(F.trim(F.regexp_replace("body", r"\n+$", ""))))


@query(
    r"""
    SELECT page_id, list_transform(list_sort(list_distinct(regexp_extract_all(html, '<a\s+href="([^"]*)"', 1))), lambda x: 'http://site' || x) AS links FROM pages
"""
)
def unique_links(spark: SparkSession, d: str) -> DataFrame:
    """Pages' menus as Markdown links."""
    md = F.regexp_replace("html", r'<a\s+href="([^"]*)"[^>]*>([^<]*)</a>', "[$2](http://site$1)")
    return table(spark, d, "pages").select("page_id", F.array_sort(M.unique_links(md)).alias("links"))


@query("SELECT page_id, url FROM pages WHERE NOT (contains(url, 'blog') OR contains(url, '#'))")
def ignored_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(~T.contains_any(F.col("url"), ["blog", "#"])).select("page_id", "url")


@query(
    r"""
    WITH links AS (
        SELECT page_id, unnest(regexp_extract_all(html, '<a\s+href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a\s+href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS title,
            generate_subscripts(regexp_extract_all(html, '<a\s+href="([^"]*)"[^>]*>([^<]*)</a>', 1), 1) AS pos FROM pages
    ), all_links AS (
        SELECT page_id, 0 AS pos, 'http://site/top' AS url, 'cover' AS title FROM pages
        UNION ALL SELECT page_id, pos, 'http://site' || href, CASE WHEN trim(title) = '' THEN 'cover' ELSE trim(title) END FROM links
    )
    SELECT page_id, pos, url, title, 'http://site/i.png' AS image FROM all_links WHERE NOT contains(title, 'The') QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1
"""
)
def news_articles(spark: SparkSession, d: str) -> DataFrame:
    """Pages' menus as linked articles, with a picture in front."""
    md = F.concat(F.lit("[![Image 1: cover](http://site/i.png)](http://site/top) "), F.regexp_replace("html", r'<a\s+href="([^"]*)"[^>]*>([^<]*)</a>', "[$2](http://site$1)"))
    return M.articles(table(spark, d, "pages").select("page_id", md.alias("md")), ["The"], "page_id", "md")


@query("SELECT conv_id, turn, role, text FROM conversations")
def streamed_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """A stream of the table goes to a JSONL sink, in ticks of one file, and is read again: every row once."""
    schema = table(spark, d, "conversations").schema
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    J.append_jsonl(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/conversations.parquet*"), f"{folder}/out", f"{folder}/state")
    return spark.read.schema(schema).json(f"{folder}/out").select("conv_id", "turn", "role", "text")


def _echo(lines: DataFrame) -> DataFrame:
    """What a service would answer: the user's words, or an error for every seventh turn."""
    get = lambda p: F.get_json_object("line", p)
    busy = F.regexp_extract(get("$.custom_id"), r"-(\d+)$", 1).cast("int") % 7 == 0
    answer = F.struct(F.concat(F.lit("heard: "), get("$.body.messages[1].content")).alias("body"))
    return lines.select(F.to_json(F.struct(get("$.custom_id").alias("custom_id"), F.when(busy, "busy").alias("error"), F.when(~busy, answer).alias("response"))).alias("line"))


def _job(spark: SparkSession, d: str, per_tick: int) -> tuple[dict, J.FolderClient]:
    root = f"{shared_folder(spark)}/job-{uuid.uuid4().hex}"
    line = L.batch_line(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn"), F.col("role"), F.col("text"))
    client = J.FolderClient(table(spark, d, "conversations").select("conv_id", "turn", line.alias("line")), ["conv_id", "turn"], f"{root}/service", _echo, per_tick)
    return J.new_jobs(spark.createDataFrame([("talks",)], "job_id string"), root).first().asDict(), client


@query(
    """
    SELECT 'c' || conv_id || '-' || turn AS custom_id, 'heard: ' || text AS value, 'done' AS status, (SELECT count(*) FROM conversations) AS line_count
    FROM conversations WHERE turn % 7 <> 0
"""
)
def batch_job_run(spark: SparkSession, d: str) -> DataFrame:
    """A job from its first step to its last, and the results in its output file."""
    job = J.run_job(*_job(spark, d, 1000))
    lines = spark.read.text(J.output_path(job)).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("pos"))
    return L.batch_results(lines).select("custom_id", "value", F.lit(job["status"]).alias("status"), F.lit(job["line_count"]).cast("long").alias("line_count"))


@query(
    """
    WITH b AS (SELECT CAST(ceil(count(*) / 200.0) AS BIGINT) AS b FROM conversations)
    SELECT n, CASE WHEN n < b THEN 0 WHEN n <= b + 2 THEN n - b + 1 WHEN n <= b + 4 THEN 3 ELSE n - b - 1 END AS next_step,
        CASE WHEN n < b THEN 'awaiting-input' WHEN n IN (b + 3, b + 4) THEN 'batch:in_progress' END AS reason, CASE WHEN n = b + 8 THEN 'done' ELSE 'active' END AS status
    FROM b, (SELECT unnest(range(1, (SELECT b + 9 FROM b))) AS n)
"""
)
def batch_tick(spark: SparkSession, d: str) -> DataFrame:
    """What a job's row says after each tick."""
    job, client = _job(spark, d, 200)
    seen = []
    while job["status"] == "active":
        job = J.tick(job, client)
        seen.append((len(seen) + 1, job["next_step"], job["reason"], job["status"]))
    return spark.createDataFrame(seen, "n long, next_step long, reason string, status string")


@query(
    """
    SELECT conv_id, turn, 'small' AS model, role AS system, text AS user, 'false' AS stream, 'object' AS format, '0.5' AS temperature, 'json_schema' AS form, 'reply' AS name, 'true' AS strict, '64' AS max_tokens
    FROM conversations
"""
)
def chat_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Requests of both kinds, read again as JSON."""
    schema = {"type": "object", "properties": {"n": {"type": "integer"}}}
    local = L.local_payload(F.col("role"), F.col("text"), "small", schema, temperature=0.5)
    hosted = L.hosted_payload(F.col("role"), F.col("text"), "small", schema, "reply", max_tokens=64)
    get = lambda c, p, name: F.get_json_object(c, p).alias(name)
    both = table(spark, d, "conversations").select("conv_id", "turn", local.alias("l"), hosted.alias("h"))
    return both.select(
        "conv_id", "turn", get("l", "$.model", "model"), get("h", "$.messages[0].content", "system"), get("l", "$.messages[1].content", "user"), get("l", "$.stream", "stream"), get("l", "$.format.type", "format"), get("l", "$.options.temperature", "temperature"),
        get("h", "$.response_format.type", "form"), get("h", "$.response_format.json_schema.name", "name"), get("h", "$.response_format.json_schema.strict", "strict"), get("h", "$.max_tokens", "max_tokens"),
    )


def _reply(prompt: str) -> str:
    if len(prompt) % 3 == 0:
        raise ValueError("busy")
    return f'```json\n{{"n": {len(prompt)},}}\n```'


@query(
    """
    SELECT doc_id, CASE length(text) % 3 WHEN 1 THEN '{"n": ' || length(text) || '}' WHEN 2 THEN '{"instead": ' || length(text) || '}' END AS value, CASE WHEN length(text) % 3 = 0 THEN 'failed' ELSE 'done' END AS status,
        CASE WHEN length(text) % 3 = 0 THEN 3 ELSE 1 END AS attempts
    FROM documents
"""
)
def asked_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies repaired, parsed and checked: kept, replaced, or given up after three tries."""
    check = lambda x: True if x["n"] % 3 == 1 else {"instead": x["n"]}
    return L.ask(table(spark, d, "documents"), _reply, check, 3, "doc_id", "text")


@query(f"SELECT doc_id, {_LETTERS.replace('(w)', '(text)')} AS embedding, 'done' AS status FROM documents")
def embedded_texts(spark: SparkSession, d: str) -> DataFrame:
    return L.embed_texts(table(spark, d, "documents"), C.letter_embed, id_col="doc_id")
