"""Requests to and replies from language models, as columns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitize_json

BATCH_WINDOW, BATCH_MODEL, BATCH_TOKENS = "24h", "gpt-4o-mini", 1000


def messages(system: Column, user: Column) -> Column:
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(one("system", system), one("user", user))


def local_payload(system: Column, user: Column, model: str, schema: Mapping | None = None, **options) -> Column:
    """Chat request of a local server as JSON: stream off, `format` the schema, other options handed through."""
    fixed = {k: v for k, v in options.items() if k not in ("schema", "schema_name")}
    fields = [F.lit(model).alias("model"), messages(system, user).alias("messages"), F.lit(False).alias("stream")]
    if schema is not None:
        fields.append(F.from_json(F.lit(json.dumps(schema)), F.schema_of_json(F.lit(json.dumps(schema)))).alias("format"))
    if fixed:
        fields.append(F.from_json(F.lit(json.dumps(fixed)), F.schema_of_json(F.lit(json.dumps(fixed)))).alias("options"))
    return F.to_json(F.struct(*fields))


def hosted_payload(system: Column, user: Column, model: str, schema: Mapping | None = None, schema_name: str | None = None, **options) -> Column:
    """Chat request of a hosted API as JSON; with a schema a strict response_format, without one the options as they are."""
    fields = [F.lit(model).alias("model"), messages(system, user).alias("messages")]
    if schema is not None:
        form = {"type": "json_schema", "json_schema": {"name": schema_name or "response_schema", "strict": True, "schema": schema}}
        fields.append(F.from_json(F.lit(json.dumps(form)), F.schema_of_json(F.lit(json.dumps(form)))).alias("response_format"))
    fields += [F.lit(v).alias(k) for k, v in options.items()]
    return F.to_json(F.struct(*fields))


def reply_content(reply: Column) -> Column:
    """The text of a reply of either kind."""
    return F.coalesce(F.get_json_object(reply, "$.message.content"), F.get_json_object(reply, "$.choices[0].message.content"))


def parse_reply(reply: Column, schema: str) -> Column:
    """Typed value of a reply's text once repaired; null where it isn't JSON."""
    return F.from_json(sanitize_json(reply_content(reply)), schema)


def ask(df: DataFrame, send: Callable[[str], str], check: Callable[[object], object] | None = None, tries: int = 3, id_col: str = "id", prompt_col: str = "prompt") -> DataFrame:
    """id, value (JSON), status, attempts: sends every prompt (send is injected), repairs and parses the
    reply and asks `check`: True keeps the parsed value, another truthy value takes its place, a falsy
    one and any error lead to the next try."""
    from ..functions.replies import parse

    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, prompt in zip(b["id"], b["prompt"]):
                value, status, n = None, "failed", 0
                for n in range(1, tries + 1):
                    try:
                        parsed = parse(send(prompt))
                        verdict = True if check is None else check(parsed)
                    except Exception:
                        continue
                    if verdict:
                        value, status = json.dumps(parsed if verdict is True else verdict, sort_keys=True), "done"
                        break
                rows.append((i, value, status, n))
            yield pd.DataFrame(rows, columns=["id", "value", "status", "attempts"])

    return df.select(F.col(id_col).alias("id"), F.col(prompt_col).alias("prompt")).mapInPandas(run, f"id {kind}, value string, status string, attempts int").withColumnRenamed("id", id_col)


#: Characters of texts that an embedder is given at once (one text at least).
EMBED_CHARS = 1 << 20


def _pieces(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    start = size = 0
    for at, text in enumerate(texts):
        if at > start and size + len(text or "") > most:
            yield start, at
            start, size = at, 0
        size += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def embed_texts(df: DataFrame, embed: Callable[[list[str]], list], retries: int = 2, timeout: float = 12.0, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, embedding, status: batches of at most EMBED_CHARS through an injected embedder, each with max(1, retries) + 1 tries."""
    from ..plans.pipeline import with_error_handling, with_retry, with_timeout

    kind = df.schema[id_col].dataType.simpleString()
    call, most = with_retry(with_timeout(with_error_handling(embed), timeout), max(1, retries)), EMBED_CHARS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for start, end in _pieces(texts, most):
                out = call(texts[start:end])
                vectors = [list(map(float, v)) for v in out.value] if out.done else [None] * (end - start)
                yield pd.DataFrame({"id": b["id"].iloc[start:end].to_numpy(), "embedding": vectors, "status": "done" if out.done else out.reason})

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, embedding array<double>, status string").withColumnRenamed("id", id_col)


def batch_line(custom_id: Column, system: Column, user: Column, model: Column | None = None, max_tokens: Column | None = None, url: str = "/v1/chat/completions") -> Column:
    """One request line of a batch file; model and max_tokens have defaults, schemas are left out."""
    body = F.struct(
        F.coalesce(model, F.lit(BATCH_MODEL)).alias("model") if model is not None else F.lit(BATCH_MODEL).alias("model"),
        F.coalesce(max_tokens, F.lit(BATCH_TOKENS)).alias("max_tokens") if max_tokens is not None else F.lit(BATCH_TOKENS).alias("max_tokens"),
        messages(system, user).alias("messages"),
    )
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body")))


def batch_results(lines: DataFrame, line_col: str = "line", pos_col: str = "pos") -> DataFrame:
    """custom_id, value: of lines without an error and with an id, response.body, else body, else the
    line; the last line of an id wins."""
    line = F.col(line_col)
    get = lambda p: F.get_json_object(line, p)
    ok = lines.where(get("$.custom_id").isNotNull() & get("$.error").isNull())
    value = F.coalesce(get("$.response.body"), get("$.body"), line)
    return ok.select(get("$.custom_id").alias("custom_id"), value.alias("value"), pos_col).groupBy("custom_id").agg(F.max_by("value", pos_col).alias("value"))


def poll(results: DataFrame, ids: DataFrame) -> DataFrame:
    """Results of the ids asked for; ids without one don't come."""
    return results.join(ids.select("custom_id"), "custom_id", "left_semi")


def numbered_prompt(items: Column, question: str) -> Column:
    from ..functions.text import numbered

    return F.concat(F.lit(question + "\n"), numbered(items))


#: System and user wording of the prompt builders; {name} takes the caller's field.
PROMPTS = {
    "articles": ("You pick news items out of page text and reply in JSON.", "The text below holds {count} items. Give title, link and picture of each.\n\n{markdown}"),
    "article_count": ("You count news items and reply in JSON.", "How many separate items does this text hold?\n\n{markdown}"),
    "single_question": ("You merge questions that ask alike and reply in JSON.", "Write one question that covers all of these:\n{cluster}\n\nThey are about this text:\n{context}"),
    "section": ("You write study questions and reply in JSON.", "Write {target} questions that this {source} settles:\n\n{section}"),
    "answer": ("You answer from a text alone and reply in JSON.", "Question (of {total} on this text): {question}\n\n{content}"),
    "snippet": ("You quote the passage that settles a question and reply in JSON.", "Question: {question}\n\n{content}"),
    "directive": ("You turn texts into instructions and reply in JSON.", "Write the instruction to which this text would be the reply:\n\n{content}"),
    "transformation": ("You turn texts into instructions and reply in JSON.", "Write an instruction that asks for this text to be changed ({transformation}):\n\n{content}"),
    "summary": ("You condense documents.", "Write a short summary of this text:\n{content}"),
}


def prompt(kind: str, **fields: Column) -> Column:
    """struct<system,user>; a field that is an array is numbered, one item a line. A null field leaves its place empty."""
    from ..functions.text import numbered

    system, user = PROMPTS[kind]
    parts, names = re.split(r"\{(\w+)\}", user), set(re.findall(r"\{(\w+)\}", user))
    if names != set(fields):
        raise TypeError(f"{kind} takes {sorted(names)}")
    filled = [F.lit(x) if i % 2 == 0 else F.coalesce(numbered(fields[x]) if x == "cluster" else fields[x].cast("string"), F.lit("")) for i, x in enumerate(parts)]
    return F.struct(F.lit(system).alias("system"), F.concat(*filled).alias("user"))
