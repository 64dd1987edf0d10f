"""HTTP, settings and models behind injectable clients."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


def setting(name: str, default: str | None = None, spark: SparkSession | None = None) -> str:
    """From the session under spark.spindrel.<name>, else the environment, else the default; a KeyError without any."""
    found = spark.conf.get(f"spark.spindrel.{name}", None) if spark else None
    found = found if found is not None else os.environ.get(name, default)
    if found is None:
        raise KeyError(name)
    return found


@dataclass(frozen=True)
class Context:
    """What calls to a model share. Retries and seconds are those of every call."""

    model: str
    endpoint: str
    key: str = ""
    retries: int = 2
    timeout: float = 12.0

    @classmethod
    def of(cls, name: str, spark: SparkSession | None = None, **given) -> Context:
        """From settings <name>_MODEL, <name>_ENDPOINT and <name>_API_KEY, where not given."""
        found = {"model": f"{name}_MODEL", "endpoint": f"{name}_ENDPOINT"}
        rest = {k: setting(v, spark=spark) for k, v in found.items() if k not in given}
        key = {} if "key" in given else {"key": setting(f"{name}_API_KEY", "", spark)}
        return cls(**given, **rest, **key)


@dataclass
class Service:
    """Calls bound to one context; send(context, payload) -> reply and embed(context, texts) -> rows are the caller's."""

    context: Context
    send: Callable[[Context, str], str] | None = None
    embed: Callable[[Context, list[str]], list] | None = None

    def ask(self, df, check: Callable | None = None, tries: int = 0, **names):
        """llm_json.ask() of payloads; no tries given: those of the context and one."""
        from ..operators.llm_json import ask

        context, send = self.context, self.send
        return ask(df, lambda p: send(context, p), check, tries or context.retries + 1, **names)

    def embed_texts(self, df, **names):
        from ..operators.llm_json import embed_texts

        context, embed = self.context, self.embed
        return embed_texts(df, lambda t: embed(context, t), context.retries, context.timeout, **names)


@dataclass
class Fetcher:
    """send(url, **options) -> (content type, bytes) is the caller's; parsing is ours."""

    send: Callable[..., tuple[str, bytes]]

    def get(self, url: str, parse_json: bool = False, raw: bool = False, map_json: Callable | None = None, **options):
        kind, body = self.send(url, **options)
        if parse_json or (not raw and "json" in kind.lower()):
            value = json.loads(body)
            return map_json(value) if map_json else value
        return body if raw else body.decode("utf-8", "replace")


@dataclass
class Models:
    """Models by key, made once per process (an executor's Python worker keeps its own)."""

    make: Callable[[str], object]
    kept: dict = field(default_factory=dict)

    def get(self, key: str) -> object:
        if key not in self.kept:
            self.kept[key] = self.make(key)
        return self.kept[key]

    def clear(self) -> None:
        self.kept.clear()


def form_data(fields: dict[str, str], file_name: str, content: bytes, boundary: str = "spindrel-part") -> bytes:
    """multipart/form-data of fields and one file."""
    out = b""
    for k, v in fields.items():
        out += f'--{boundary}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode()
    out += f'--{boundary}\r\nContent-Disposition: form-data; name="file"; filename="{file_name}"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode()
    return out + content + f"\r\n--{boundary}--\r\n".encode()
