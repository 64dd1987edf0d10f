"""Semantic chunking: text is cut where neighbouring windows of sentences differ most."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import preprocess, sentences
from ..sources.tables import fresh
from .markdown import split_markdown

Embed = Callable[[list[str]], np.ndarray]


@dataclass(frozen=True)
class ChunkOptions:
    buffer: int = 2
    percentile: float = 90
    min_chars: int = 300
    max_chars: float = 2000
    overlap: int = 1
    headings_only: bool = False
    markdown: bool = False
    #: keep a last chunk below min_chars, which is dropped by default
    keep_tail: bool = False


def letter_embed(texts: list[str]) -> np.ndarray:
    """Counts of a to z, one row per text."""
    data = "\n".join(t.lower().replace("\n", " ") for t in texts).encode("utf-8", "replace")
    codes = np.frombuffer(data, np.uint8)
    row = np.cumsum(codes == 10)
    letter = (codes >= 97) & (codes <= 122)
    return np.bincount(row[letter] * 26 + codes[letter] - 97, minlength=26 * len(texts)).reshape(-1, 26)[: len(texts)].astype(np.float64)


def distances(vectors: np.ndarray, digits: int | None = None) -> list[float]:
    """1 - cosine of consecutive vectors, NaN left out (so later ones move up). A zero vector has cosine 0."""
    if len(vectors) < 2:
        return []
    squares = (vectors * vectors).sum(1)
    norm = np.sqrt(squares[:-1] * squares[1:])
    with np.errstate(invalid="ignore", divide="ignore"):
        out = 1 - np.where(norm == 0, 0.0, (vectors[:-1] * vectors[1:]).sum(1) / norm)
    out = out[~np.isnan(out)]
    return (np.round(out, digits) if digits is not None else out).tolist()


def threshold(values: list[float], percentile: float) -> float:
    """Lower nearest rank; NaN without values."""
    return sorted(values)[math.floor(percentile / 100 * (len(values) - 1))] if values else math.nan


def fold(segments: list[str], gaps: list[float], limit: float, o: ChunkOptions) -> list[str]:
    """Cuts segments where a gap reaches the limit or a chunk outgrows max_chars, if it has min_chars by then.

    The last gap never cuts. max_chars asks for a cut and doesn't enforce one. A
    last chunk below min_chars goes unless it is the only one.
    """
    if math.isnan(limit):
        return ["\n".join(segments)]
    out: list[str] = []
    start = 0
    for i in range(len(gaps) - 1):
        text = "\n".join(segments[start : i + o.buffer])
        if (gaps[i] >= limit or len(text) > o.max_chars) and len(text) >= o.min_chars:
            out.append(text)
            start = max(i + o.buffer - o.overlap, start + 1)
    if start < len(segments):
        text = "\n".join(segments[start:])
        if len(text) >= o.min_chars or not out or o.keep_tail:
            out.append(text)
    return out


def chunk_segments(segments: list[str], embed: Embed, o: ChunkOptions, digits: int | None = None) -> list[str]:
    if len(segments) <= o.buffer:
        segments = ["\n".join(segments)]
    spans = [" ".join(segments[i : i + o.buffer]) for i in range(len(segments) - o.buffer + 1)]
    gaps = distances(np.asarray(embed(spans)), digits) if spans else []
    if not gaps:
        return ["\n".join(segments)]
    return fold(segments, gaps, threshold(gaps, o.percentile), o)


def _chunker(embed: Embed, o: ChunkOptions, digits: int | None, attempts: int, rescue: bool, timeout: float, keep: list[str]):
    from ..plans.pipeline import with_error_handling, with_retry, with_timeout

    def one(segments: list[str], text: str) -> tuple[list[str] | None, str]:
        step = with_retry(with_timeout(with_error_handling(lambda s: chunk_segments(s, embed, o, digits) or [text]), timeout), attempts - 1)
        out = step(segments)
        return (out.value, "done") if out.done else ([text] if rescue else None, out.reason)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chunks, status = [], []
            for text, segments in zip(batch["text"], batch["segments"]):
                if text is None:
                    chunks.append(None)
                    status.append("empty")
                    continue
                early = [s["text"] for s in split_markdown(text, 30, o.max_chars, o.headings_only)] if o.markdown else list(segments)
                if len(early) <= max(1, o.buffer):
                    chunks.append([text])
                    status.append("done")
                    continue
                if o.markdown:
                    early = [s["text"] for s in split_markdown(text, o.min_chars, o.max_chars, o.headings_only)]
                made, how = one(early, text)
                chunks.append(made)
                status.append(how)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "chunks": chunks, "status": status, **{c: batch[c] for c in keep}})

    return run


def chunk_documents(docs: DataFrame, options: ChunkOptions = ChunkOptions(), embed: Embed = letter_embed, id_col: str = "doc_id", text_col: str = "text", digits: int | None = None, attempts: int = 1, rescue: bool = False, timeout: float = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, chunks, status of every document, and its columns `keep`.

    Clean-up and sentences are columns; windows, embedding, distances and the
    ordered fold take one pass over Arrow batches, one document at a time, so
    nothing is shuffled. `embed` maps texts to rows and may raise: after
    `attempts` the status is retryExceeded, and timeout if a call takes longer than
    `timeout` seconds (0: no limit), with the whole text as one chunk when `rescue`
    is set. A null text has null chunks and the status empty.
    """
    text = F.col(text_col)
    segments = F.array().cast("array<string>") if options.markdown else sentences(preprocess(text), True)
    names = [fresh(["doc_id", "text", "segments", "chunks", "status"], c) for c in keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), segments.alias("segments"), *[F.col(c).alias(n) for c, n in zip(keep, names)])
    kind = rows.schema["doc_id"].dataType.simpleString()
    more = "".join(f", `{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInPandas(_chunker(embed, options, digits, attempts, rescue, timeout, names), f"doc_id {kind}, chunks array<string>, status string{more}")


def window_gaps(docs: DataFrame, buffer: int = 2, embed: Embed = letter_embed, id_col: str = "doc_id", text_col: str = "text", digits: int | None = None) -> DataFrame:
    """doc_id, d: distances of consecutive windows of every document that has two windows or more.

    One pass over Arrow batches: as nested column expressions the vectors are
    computed again at every use.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), sentences(preprocess(F.col(text_col)), True).alias("segments")).where(F.size("segments") > buffer)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [[" ".join(s[i : i + buffer]) for i in range(len(s) - buffer + 1)] for s in batch["segments"].map(list)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "d": [distances(np.asarray(embed(x)), digits) for x in spans]})

    return rows.mapInPandas(gaps, f"doc_id {kind}, d array<double>")


def exploded(chunked: DataFrame) -> DataFrame:
    """doc_id, pos, chunk."""
    return chunked.select("doc_id", F.posexplode("chunks").alias("pos", "chunk"))
